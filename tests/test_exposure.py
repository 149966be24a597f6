import random

from keysift.operators import exposure as E
from tests.test_detect import POSITIVE

KINDS = {"GITHUB_PAT": "vcs_token", "NPM_TOKEN": "vcs_token", "STRIPE_SECRET_KEY": "api_key", "AWS_ACCESS_KEY_ID": "cloud_credential"}
SCHEMA = "lang string, source string, content string, n_files int"


def brute(rows):
    out = {}
    for lang_all in (False, True):
        for source_all in (False, True):
            groups = {}
            for lang, source, kinds in rows:
                groups.setdefault((None if lang_all else lang, None if source_all else source), []).append(kinds)
            for key, files in groups.items():
                for c in ("any", *E.CATEGORIES):
                    n = sum(bool(k) if c == "any" else c in k for k in files)
                    out[(*key, 2 * lang_all + source_all, c)] = (len(files), n, n / len(files))
    return out


def test_every_level_counts_each_file_once(spark):
    draw = random.Random(2)
    rows, files = [], []
    for _ in range(200):
        kinds = draw.choices(list(KINDS), k=draw.choice([0, 0, 1, 2, 3]))
        lang, source = draw.choice(["en", "de", None]), draw.choice(["a", "b", None, ""])
        rows.append((lang, source, {KINDS[k] for k in kinds}))
        files.append((lang, source, " \n ".join(POSITIVE[k] for k in kinds) if kinds else draw.choice([None, "", "text"]), 7))
    got = {(r.lang, r.source, r.level, r.category): (r.n_files, r.n_exposed, r.rate)
           for r in E.exposure_rates(spark.createDataFrame(files, SCHEMA).repartition(3)).collect()}
    assert got == brute(rows)


def test_one_dimension_and_nothing(spark):
    files = spark.createDataFrame([("en", "a", POSITIVE["NPM_TOKEN"], 1)], SCHEMA)
    rows = {(r.lang, r.level, r.category): r.n_exposed for r in E.exposure_rates(files, ["lang"]).collect()}
    assert rows["en", 0, "any"] == 1 and rows[None, 1, "vcs_token"] == 1 and rows["en", 0, "api_key"] == 0 and len(rows) == 14
    assert E.exposure_rates(files.limit(0)).collect() == []
