"""The rule catalogue: what counts as a secret, and how each kind is recognised.

Rules are plain data.  ``RULES`` is turned into literal-pattern Columns by
``keysift.operators.detect`` and into a small lookup frame by
``keysift.operators.listing``.
A user extends detection by passing ``RULES + [Rule(...)]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# The six categories, in report order, with their headings.
CATEGORIES = {
    "private_key": "Private Keys",
    "cloud_credential": "Cloud Credentials",
    "api_key": "API Keys / SaaS",
    "vcs_token": "VCS / Registry Tokens",
    "oauth_token": "OAuth / JWT",
    "database_credential": "Database Credentials",
}


@dataclass(frozen=True)
class Rule:
    """One kind of secret.

    ``pattern`` is written in the common regular-expression dialect; group 1 is
    the value whose length is checked and whose first characters are sampled.
    When ``whole`` is true the value is the whole match.  ``flags`` holds ``s``
    (dot matches newline) and/or ``i`` (ignore case).  ``needs`` lists literals
    without which the pattern cannot match: every inner tuple must contribute at
    least one literal found in the text (lower case for ``i`` rules).  It only
    saves work; leaving it empty means the pattern is always tried.  Any part of a
    necessary word will do, and one whose first character is rare is found missing
    soonest.
    ``search_query`` is the quoted-phrase search that selects candidate files.
    ``anchors`` join the built-in ones wherever the rule is used: a text that holds
    no anchor of any rule in use is not scanned.
    """

    secret_id: str
    category: str
    label: str
    confidence: str
    pattern: str
    flags: str
    min_length: int
    max_length: int | None
    search_query: str
    whole: bool = True
    needs: tuple[tuple[str, ...], ...] = ()
    anchors: tuple[str, ...] = ()

    @property
    def phrases(self) -> list[str]:
        """The quoted parts of the search; all must occur in a selected file."""
        return re.findall(r'"([^"]*)"', self.search_query)


def _pem(secret_id: str, label: str, kind: str, tail: str = "PRIVATE KEY") -> Rule:
    """A PEM block: header, lazily matched body (the value), footer."""
    name = f"{kind} {tail}".strip()
    head, foot = f"-----BEGIN {name}-----", f"-----END {name}-----"
    return Rule(secret_id, "private_key", label, "high", f"{head}(.+?){foot}", "s", 50, None,
                f'"BEGIN {name}"', whole=False, needs=(("PRIVATE KEY",), (head,), (foot,)))


# The thirty rules, in evaluation order.
RULES: list[Rule] = [
    _pem("OPENSSH_PRIVATE_KEY", "OpenSSH Private Key", "OPENSSH"),
    _pem("RSA_PRIVATE_KEY", "RSA Private Key (PKCS#1)", "RSA"),
    _pem("EC_PRIVATE_KEY", "EC Private Key", "EC"),
    _pem("DSA_PRIVATE_KEY", "DSA Private Key", "DSA"),
    _pem("PKCS8_PRIVATE_KEY", "PKCS#8 Private Key", ""),
    _pem("PKCS8_ENC_PRIVATE_KEY", "Encrypted PKCS#8 Private Key", "ENCRYPTED"),
    _pem("PGP_PRIVATE_KEY", "PGP/GPG Private Key Block", "PGP", "PRIVATE KEY BLOCK"),
    Rule("AWS_ACCESS_KEY_ID", "cloud_credential", "AWS Access Key ID", "high",
         r"(?<![A-Z0-9])((?:AKIA|AROA|ABIA|ACCA|ASIA)[A-Z0-9]{16})(?![A-Z0-9])", "", 20, 20,
         '"AKIA"', needs=(("AKIA", "AROA", "ABIA", "ACCA", "ASIA"),)),
    Rule("AWS_SECRET_ACCESS_KEY", "cloud_credential", "AWS Secret Access Key", "high",
         r"""(?:aws.?secret.?(?:access.?)?key|AWS_SECRET_ACCESS_KEY)[\s"'`]*[=:]\s*["'`]?([A-Za-z0-9/+]{40})["'`]?""",
         "i", 40, 40, '"AWS_SECRET_ACCESS_KEY"', whole=False, needs=(("key",), ("ws",), ("secret",))),
    Rule("GCP_SERVICE_ACCOUNT_KEY", "cloud_credential", "GCP Service Account Key (JSON)", "high",
         r'"type"\s*:\s*"service_account"', "i", 0, None,
         '"type": "service_account"', needs=(('"service_account"',),)),
    Rule("GCP_API_KEY", "cloud_credential", "Google API Key", "high",
         r"(AIza[A-Za-z0-9_\-]{35})", "", 39, 39, '"AIza"', needs=(("AIza",),)),
    Rule("GCP_OAUTH_CLIENT_SECRET", "cloud_credential", "Google OAuth Client Secret", "high",
         r'"client_secret"\s*:\s*"(GOCSPX-[A-Za-z0-9_\-]{28})"', "", 35, None,
         '"GOCSPX-"', whole=False, needs=(('"GOCSPX-',),)),
    Rule("AZURE_CLIENT_SECRET", "cloud_credential", "Azure Client Secret / Service Principal", "medium",
         r"""(?:client.?secret|AZURE_CLIENT_SECRET|clientSecret)[\s"'`]*[=:]\s*["'`]?([A-Za-z0-9~._\-]{34,40})["'`]?""",
         "i", 34, 40, '"AZURE_CLIENT_SECRET"', whole=False, needs=(("client",), ("cret",))),
    Rule("AZURE_CONNECTION_STRING", "cloud_credential", "Azure Storage Connection String", "high",
         r"DefaultEndpointsProtocol=https;AccountName=[^;]+;AccountKey=([A-Za-z0-9+/=]{88});", "i", 88, 88,
         '"DefaultEndpointsProtocol=https;AccountName"', whole=False, needs=(("key=",), (";accountkey=",))),
    Rule("GITHUB_PAT", "vcs_token", "GitHub Personal Access Token", "high",
         r"((?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{59})", "", 40, None,
         '"ghp_"', needs=(("_",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"))),
    Rule("GITLAB_TOKEN", "vcs_token", "GitLab Personal Access Token", "high",
         r"(glpat-[A-Za-z0-9_\-]{20,})", "", 26, None, '"glpat-"', needs=(("pat-",),)),
    Rule("NPM_TOKEN", "vcs_token", "NPM Access Token", "high",
         r"(npm_[A-Za-z0-9]{36})", "", 40, None, '"npm_"', needs=(("pm_",),)),
    Rule("PYPI_TOKEN", "vcs_token", "PyPI API Token", "high",
         r"(pypi-[A-Za-z0-9_\-]{32,})", "", 37, None, '"pypi-"', needs=(("ypi-",),)),
    Rule("STRIPE_SECRET_KEY", "api_key", "Stripe Secret API Key", "high",
         r"(sk_(?:live|test)_[A-Za-z0-9]{24,})", "", 32, None,
         '"sk_live_"', needs=(("k_live_", "k_test_"),)),
    Rule("STRIPE_RESTRICTED_KEY", "api_key", "Stripe Restricted API Key", "high",
         r"(rk_(?:live|test)_[A-Za-z0-9]{24,})", "", 32, None,
         '"rk_live_"', needs=(("k_live_", "k_test_"),)),
    Rule("TWILIO_ACCOUNT_SID", "api_key", "Twilio Account SID", "high",
         r"(AC[a-f0-9]{32})", "", 34, 34, '"AccountSid"', needs=(("AC",),)),
    Rule("TWILIO_AUTH_TOKEN", "api_key", "Twilio Auth Token", "medium",
         r"""(?:twilio.?auth.?token|TWILIO_AUTH_TOKEN|authToken)[\s"'`]*[=:]\s*["'`]?([a-f0-9]{32})["'`]?""",
         "i", 32, 32, '"TWILIO_AUTH_TOKEN"', whole=False, needs=(("ken",), ("uth",))),
    Rule("SENDGRID_API_KEY", "api_key", "SendGrid API Key", "high",
         r"(SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})", "", 69, None, '"SG."', needs=(("SG.",),)),
    Rule("SLACK_TOKEN", "api_key", "Slack API Token", "high",
         r"(xox[bparise]-[A-Za-z0-9\-]{10,})", "", 30, None, '"xoxb-"', needs=(("xox",),)),
    Rule("TELEGRAM_BOT_TOKEN", "api_key", "Telegram Bot API Token", "medium",
         r"(\d{8,10}:[A-Za-z0-9_\-]{35})", "", 44, None, '"api.telegram.org/bot"', needs=((":",),)),
    Rule("MAILGUN_API_KEY", "api_key", "Mailgun API Key", "medium",
         r"(key-[a-f0-9]{32})", "", 36, 36, '"mailgun" "key-"', needs=(("key-",),)),
    Rule("HEROKU_API_KEY", "api_key", "Heroku API Key", "medium",
         r"""(?:heroku.?api.?key|HEROKU_API_KEY)[\s"'`]*[=:]\s*["'`]?([0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})["'`]?""",
         "i", 36, 36, '"HEROKU_API_KEY"', whole=False, needs=(("ku",), ("key",), ("heroku",))),
    Rule("JWT_TOKEN", "oauth_token", "JSON Web Token (JWT)", "medium",
         r"(eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)", "", 50, None, '"eyJ"', needs=(("yJ",),)),
    Rule("GENERIC_BEARER_TOKEN", "oauth_token", "OAuth Bearer / Access Token", "low",
         r"""(?:bearer|access.?token|oauth.?token)[\s"'`]*[=:]\s*["'`]?([A-Za-z0-9\-_.]{32,})["'`]?""",
         "i", 32, None, '"access_token"', whole=False, needs=(("ken", "bearer"),)),
    Rule("DATABASE_URL", "database_credential", "Database Connection String with Credentials", "high",
         r"""((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis(?:s)?|mssql|oracle)://[A-Za-z0-9_.\-]+:[^@\s"'`]{8,}@[A-Za-z0-9._:\-/]+)""",
         "i", 20, None, '"postgres://"', needs=(("://",), ("@",))),
]

# A text holding none of these (in any letter case) is not scanned at all.
ANCHORS = [
    "-----BEGIN",
    "AKIA", "AROA", "ABIA", "ACCA", "ASIA", "AWS_SECRET", "aws_secret",
    "AIza", "GOCSPX-", "service_account",
    "DefaultEndpointsProtocol", "AZURE_CLIENT_SECRET", "client_secret", "clientSecret",
    "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "npm_", "pypi-",
    "sk_live_", "sk_test_", "rk_live_", "rk_test_",
    "AccountSid", "account_sid", "AC", "TWILIO_AUTH_TOKEN", "twilio_auth", "authToken",
    "SG.", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-",
    "api.telegram.org/bot", "HEROKU_API_KEY", "heroku_api", "MAILGUN", "mailgun", "key-",
    "eyJ", "access_token", "oauth_token", "bearer",
    "postgres://", "postgresql://", "mysql://", "mongodb://", "mongodb+srv://",
    "redis://", "rediss://", "mssql://", "oracle://",
]


def anchors_of(rules) -> list[str]:
    """The anchors in force when ``rules`` are used."""
    return [*ANCHORS, *(a for rule in rules or () for a in rule.anchors)]


# Fixed value: private-key headers counted for the bulk signals (ignore case).
PEM_HEADER = "-----BEGIN (?:OPENSSH |RSA |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY"

# Characters that Unicode-aware ``\s`` and ``strip`` treat as white space; Java's own
# ``\s`` knows only the ASCII ones, so patterns are given the full set explicitly.
WHITESPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def jvm_pattern(pattern: str, flags: str = "") -> str:
    r"""Write a catalogue pattern for the regular-expression engine Spark uses.

    ``\s`` and ``\d`` become their Unicode sets, ``.`` stops only at ``\n`` (``d``),
    and ignoring case is Unicode-aware (``u``).
    """
    in_class = re.sub(r"(\[[^\]]*)\\s", lambda m: m.group(1) + WHITESPACE, pattern)
    spelled = in_class.replace(r"\s", f"[{WHITESPACE}]").replace(r"\d", r"\p{Nd}")
    return f"(?d{'s' if 's' in flags else ''}{'iu' if 'i' in flags else ''}){spelled}"
