import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import brute
from keysift.catalog import ANCHORS, CATEGORIES, RULES, WHITESPACE, Rule
from keysift.operators import detect as D

HEX = "0123456789abcdef" * 10


def block(kind, body="a" * 64, tail="PRIVATE KEY"):
    name = f"{kind} {tail}".strip()
    return f"-----BEGIN {name}-----\n{body}\n-----END {name}-----"


# One finished example per rule, put together here so that no token stands in the file.
POSITIVE = {
    "OPENSSH_PRIVATE_KEY": block("OPENSSH"), "RSA_PRIVATE_KEY": block("RSA"), "EC_PRIVATE_KEY": block("EC"),
    "DSA_PRIVATE_KEY": block("DSA"), "PKCS8_PRIVATE_KEY": block(""), "PKCS8_ENC_PRIVATE_KEY": block("ENCRYPTED"),
    "PGP_PRIVATE_KEY": block("PGP", tail="PRIVATE KEY BLOCK"),
    "AWS_ACCESS_KEY_ID": "x AK" + "IA" + "B" * 16 + " y",
    "AWS_SECRET_ACCESS_KEY": "AWS_SECRET_ACCESS_KEY = " + HEX[:40],
    "GCP_SERVICE_ACCOUNT_KEY": '{"type" : "service_account"}',
    "GCP_API_KEY": "AI" + "za" + HEX[:35],
    "GCP_OAUTH_CLIENT_SECRET": '"client_secret": "GOC' + "SPX-" + HEX[:28] + '"',
    "AZURE_CLIENT_SECRET": "clientSecret: '" + HEX[:36] + "'",
    "AZURE_CONNECTION_STRING": "DefaultEndpointsProtocol=https;AccountName=a;AccountKey=" + HEX[:88] + ";",
    "GITHUB_PAT": "gh" + "o_" + HEX[:36], "GITLAB_TOKEN": "glp" + "at-" + HEX[:20], "NPM_TOKEN": "np" + "m_" + HEX[:36],
    "PYPI_TOKEN": "py" + "pi-" + HEX[:32], "STRIPE_SECRET_KEY": "sk_" + "test_" + HEX[:24],
    "STRIPE_RESTRICTED_KEY": "rk_" + "live_" + HEX[:24], "TWILIO_ACCOUNT_SID": "A" + "C" + HEX[:32],
    "TWILIO_AUTH_TOKEN": "authToken: \"" + HEX[:32] + '"', "SENDGRID_API_KEY": "S" + "G." + HEX[:22] + "." + HEX[:43],
    "SLACK_TOKEN": "xo" + "xp-" + HEX[:25], "TELEGRAM_BOT_TOKEN": "api.telegram.org/bot12345678:" + HEX[:35],
    "MAILGUN_API_KEY": "key" + "-" + HEX[:32],
    "HEROKU_API_KEY": "heroku_api_key=01234567-89ab-4def-8123-0123456789ab",
    "JWT_TOKEN": "ey" + "J" + HEX[:20] + "." + HEX[:20] + "." + HEX[:20],
    "GENERIC_BEARER_TOKEN": "oauth_token='" + HEX[:40] + "'",
    "DATABASE_URL": "mongodb+srv://user:longpassword@host.example/db",
}

NEGATIVE = [
    "", "A plain sentence about a project.", "-----BEGIN RSA PRIVATE KEY-----\nnever closed",
    block("RSA", "short"), "AK" + "IA" + "B" * 15, "AK" + "IA" + "B" * 17, "ABCD" + "B" * 16,
    "ey" + "Jab.cd", "ey" + "J" + "a" * 30 + "." + "b" * 30, "postgres://user:short@host", "postgres://user@host/db",
    "xo" + "xb-" + "1" * 12, "AWS_SECRET_ACCESS_KEY = " + "x" * 39 + "!",
]

TRICKY = [
    # The anchor list has no xoxe-; only another anchor lets the rule see it.
    "xo" + "xe-" + HEX[:30], "key" + "- xo" + "xe-" + HEX[:30],
    # Letters that fold to ASCII, dots that stop only at line feeds, Unicode white space.
    "aws_\u017fecret_\u212aey = " + HEX[:40], "AWS\rSECRET\rKEY = " + HEX[:40] + " ac", "aws\nsecret\nkey = " + HEX[:40],
    "access_token\u00a0=\u2003" + HEX[:40], "access_token\x1c:\x85" + HEX[:40], "bot\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668:" + HEX[:35] + " ac",
    "CL\u0130ENT_SECRET=" + HEX[:36], "cl\u0131ent_secret=" + HEX[:36],
    # Body white space is stripped before the length test; samples count characters, not bytes.
    block("EC", " " * 60 + "x" * 10), block("EC", "\u00a0" * 30 + "x" * 50), block("EC", "😀" * 50),
    # Repeats in and across rules; an unclosed header swallowing a later block; several on one line.
    block("RSA") + "\n" + block("RSA"), "-----BEGIN RSA PRIVATE KEY-----\n" + block("RSA") + block("RSA", "b" * 70),
    POSITIVE["GCP_OAUTH_CLIENT_SECRET"] * 2, POSITIVE["DATABASE_URL"] + " " + POSITIVE["DATABASE_URL"].upper(),
    "bearer: ey" + "J" + HEX[:20] + "." + HEX[:20] + "." + HEX[:20],
    "AK" + "IA" + "B" * 16 + " AK" + "IA" + "C" * 16 + ",AK" + "IA" + "D" * 16,
    "\n".join(block("RSA", f"{i:064d}") for i in range(130)),
]


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string").repartition(8)
    return {r.file_id: ([(s.ord, s.sha, s["sample"]) for s in r.secrets], r.pem_headers)
            for r in D.detect(df).collect()}


def check(spark, texts):
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == (brute.detect(t), brute.pem_headers(t)), repr(t)


def test_catalogue():
    assert len(RULES) == 30 == len({r.secret_id for r in RULES}) and len(ANCHORS) == 59
    assert {r.category for r in RULES} == set(CATEGORIES)
    assert {r.confidence for r in RULES} == {"high", "medium", "low"}
    assert all(r.search_query and r.label for r in RULES)


def test_white_space_set_is_complete():
    import re
    ours = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), WHITESPACE) + "]")
    assert all(bool(ours.match(chr(c))) == chr(c).isspace() for c in range(0x11000))


def test_each_rule_finds_its_example(spark):
    got = scan(spark, list(POSITIVE.values()))
    for i, secret_id in enumerate(POSITIVE):
        assert secret_id in [RULES[o - 1].secret_id for o, _, _ in got[i][0]], secret_id


def test_negatives_and_null(spark):
    got = scan(spark, NEGATIVE + [None])
    assert all(v[0] == [] for v in got.values())


def test_matches_brute_force_on_examples(spark):
    check(spark, list(POSITIVE.values()) + NEGATIVE + TRICKY + ["\n".join(POSITIVE.values())])


def test_matches_brute_force_on_corpus(spark, corpus):
    texts = [r.content for r in corpus.files.select("content").collect()]
    check(spark, texts)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 2**32))
def test_matches_brute_force_on_random_mixtures(spark, seed):
    rnd = random.Random(seed)
    pieces = [*POSITIVE.values(), *NEGATIVE, *TRICKY, "ac ", " ", "\n", "=", "token", "é", "secret key", "\x85"]
    def cut(p):
        return p[rnd.randrange(len(p) + 1):] if rnd.random() < 0.2 else p
    check(spark, ["".join(cut(rnd.choice(pieces)) for _ in range(rnd.randrange(1, 8))) for _ in range(60)])


def test_contains_secret_agrees(spark):
    texts = [*POSITIVE.values(), *NEGATIVE, *TRICKY, None, "Mac", "M\u0130 \u212aEY-", "bearer", "SG.", "sg."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = {r.i: r.x for r in df.select("i", D.contains_secret().alias("x")).collect()}
    assert got == {i: brute.has_anchor(t) for i, t in enumerate(texts)}


def test_pem_headers_count_repeats_and_unclosed(spark):
    text = block("RSA") * 2 + "-----begin private key" + "-----BEGIN PGP PRIVATE KEY BLOCK"
    assert scan(spark, [text])[0][1] == 4


def test_no_value_leaves_detection(spark, corpus):
    found = D.detections(corpus.files)
    assert "content" not in found.columns
    for row in found.collect():
        assert all("PRIVATE KEY-----" not in str(v) for v in row) and len(row.sha256_fingerprint) == 64
        assert row.redacted_sample.endswith("****") and len(row.redacted_sample) <= 8


def test_result_does_not_depend_on_partitions(spark, corpus):
    files = corpus.files.select("file_id", "content")
    one = {(r.file_id, str(r.secrets)) for r in D.detect(files.repartition(1)).collect()}
    many = {(r.file_id, str(r.secrets)) for r in D.detect(files.repartition(13)).collect()}
    halves = {(r.file_id, str(r.secrets)) for h in (0, 1)
              for r in D.detect(files.where(F.col("file_id") % 2 == h)).collect()}
    assert one == many == halves


def test_detection_is_one_narrow_stage(spark, corpus):
    plan = D.detect(corpus.files.select("file_id", "content"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    exploded = D.detections(corpus.files)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert exploded.count("regexp_extract_all") == 30  # no pattern runs twice


def test_user_rule(spark):
    rule = Rule("MY_TOKEN", "api_key", "Mine", "low", r'token = "([a-f0-9]{40})"', "", 40, 40, '"token"', whole=False,
                anchors=("token = ",))
    df = spark.createDataFrame([(1, 'token = "' + HEX[:40] + '"'), (2, "token = none")], "file_id int, content string")
    found = D.detections(df, rules=[*RULES, rule]).collect()
    assert D.detections(df, rules=[*RULES, rule], anchors=ANCHORS).count() == 0  # nothing else anchors it
    assert [(r.file_id, r.secret_id, r.redacted_sample) for r in found] == [(1, "MY_TOKEN", "0123****")]


def test_group_by_category(spark):
    text = POSITIVE["RSA_PRIVATE_KEY"] + " " + POSITIVE["NPM_TOKEN"] + " " + POSITIVE["GITLAB_TOKEN"]
    rows = D.group_by_category(D.detect(spark.createDataFrame([(1, text)], "file_id int, content string"))).collect()
    assert {r.category: r.secret_ids for r in rows} == {
        "private_key": ["RSA_PRIVATE_KEY"], "vcs_token": ["GITLAB_TOKEN", "NPM_TOKEN"]}


@pytest.mark.parametrize("text, matches, fitting", [("xo" + "xb-" + "1" * 12, 1, 0), ("xo" + "xb-" + "1" * 30, 1, 1)])
def test_length_limits(spark, text, matches, fitting):
    row = D.match_counts(spark.createDataFrame([(1, text)], "file_id int, content string")).first()
    assert (row.secret_id, row.n_matches, row.n_fitting) == ("SLACK_TOKEN", matches, fitting)
