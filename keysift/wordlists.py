"""Word lists, weights and thresholds used by scoring and trend analysis.

Fixed values throughout: results depend on these entries and on their order.
"""

# Repository-name words that suggest a deliberate dump; the first listed hit is reported.
DUMP_KEYWORDS = [
    "leak", "dump", "stealer", "logs", "creds", "credentials", "grabber", "harvest",
    "collection", "combolist", "combo", "hacked", "pwned", "breach", "database", "db-dump",
    "loot", "exfil", "stolen", "private-key", "ssh-keys",
]

# Lower-cased paths that belong to ordinary projects.
DEV_PATHS = [
    r"^\.ssh/", r"id_rsa\n?\z", r"id_ed25519\n?\z", r"id_ecdsa\n?\z", r"id_dsa\n?\z",
    r"ansible.*vault", r"terraform.*key", r"vagrant.*key", r"config/ssh", r"test.*key",
    r"fixtures?/", r"examples?/", r"sample", r"\.github/",
]

# Topics that mark research or training material.
RESEARCH_TOPICS = [
    "ctf", "pentest", "security-research", "red-team", "capture-the-flag", "hackthebox", "tryhackme",
]

# Account names that look generated or boastful.
SUSPICIOUS_LOGINS = [r"^[a-z0-9]{8,16}\n?\z", r"\p{Nd}{6,}", r"(?iu)(hack|crack|steal|leak|dump|ghost|anon)"]

# Score contributions.
WEIGHTS = {
    "dump_keyword": 0.45, "non_owner": 0.25, "mass": 0.40, "bulk": 0.25, "gist": 0.20,
    "username": 0.15, "new_account": 0.20, "ssh_single": 0.40, "test_path": 0.20,
    "dev_path": 0.30, "pem": 0.10, "topic": 0.10,
}
MASS_KEYS, BULK_KEYS, NEW_ACCOUNT_DAYS, PEM_SCORE_MAX = 100, 10, 30, 0.10
LEAKED_MIN, ACCIDENTAL_MAX = 0.40, 0.15

# Words counted in the names of repositories with leaked findings.
TAXONOMY_KEYWORDS = [
    "stealer", "grabber", "logs", "dump", "leak", "combo", "collection", "credentials", "creds",
    "hacked", "breach", "database", "loot", "harvest", "exfil", "stolen", "keylogger", "rat",
    "botnet", "infostealer", "malware", "panel", "bot", "c2",
]
NOISE_TOKENS = ["the", "a", "an", "is", "of", "in", "and", "or", "to", "for", ""]

# Names found next to keys in stealer logs.
STEALER_ARTIFACTS = [
    "passwords.txt", "passwords.csv", "logins.txt", "cookies.txt", "cookies.json", "autofill.txt",
    "credit_cards.txt", "cc.txt", "metamask", "exodus", "electrum", "discord_tokens",
    "telegram_session", "system_info.txt", "userinfo.txt", "screenshot.png", "screen.jpg",
]

# Effort implied by the main language; anything else scores 1.
LANGUAGE_SCORES = {
    "C": 5, "C++": 5, "Rust": 5, "Go": 4, "Python": 3, "Ruby": 3, "PowerShell": 3,
    "JavaScript": 2, "PHP": 2, "Perl": 2, "Batch": 1, "Shell": 1, "HTML": 0, "Text": 0,
}

# Account age in days (exclusive upper bound) and its label.
AGE_BANDS = [
    (7, "< 1 week  (almost certainly throwaway)"),
    (30, "< 1 month (very suspicious)"),
    (90, "< 3 months (suspicious)"),
    (365, "< 1 year  (moderate)"),
    (9999, "≥ 1 year  (established)"),
]

# An account is a suspected automation when at least two of these hold.
AUTO_FINDINGS_MIN, AUTO_AGE_MAX, AUTO_KEYS_MIN = 5, 90, 50

# Report buckets, always listed in full and in this order.
TIERS = ["low (0-3)", "medium (4-6)", "high (7-10)"]
VOLUME_BUCKETS = {
    "1": "Likely accidental single commit",
    "2-9": "Small batch or multiple accidental",
    "10-99": "Probable stealer log fragment",
    "100+": "Stealer infrastructure / mass dump",
}
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
BATCH_REPOS_MIN, BATCH_EVIDENCE_MAX = 3, 5
TOP_ACCOUNTS, TOP_TOKENS, TOP_ARTIFACTS = 10, 20, 10
ABANDONED_DAYS = 180
