"""Secrets in texts, told apart by how many repositories and owners share them.

Three base kinds are found by pattern.  The method adds a fourth, ``owned``: a long
mixed run of letters and digits that stands outside any base secret and whose hash
occurs with few owners in the whole corpus.  Candidate hashes are counted by distinct
repositories and owners over all rows; a value that many owners share is an example
copied around, one that stays with few owners looks live, and a live one in several repositories is
reused: it opens more than one door.  Values never leave the scan, only their hashes.  DataFrame functions throughout.

Pattern matches have no offsets in Spark, so the text is split at the same pattern: the
lengths of the pieces and matches before a match add up to its start, in code points.

Defined cases.  A null text is empty and has no spans.  Empty or null repositories and
owners count as one unknown each.  Repeated rows are judged one by one and give equal
results.  No rows give no rows.  Input columns are read by name and may clash with any
name used here, as everything else is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.llm.names import unused
from keysift.plans.durable import materialise

# Pattern, group that is the value, least characters of the value.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
# The added kind: its pattern, and the characters that make a run look random.
OWNED = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
MIXED = ("[a-z]", "[A-Z]", "[0-9]")
# From so many distinct owners on, a value is a copied example.
EXAMPLE_OWNERS = 3
# From so many distinct repositories on, a live value counts as reused.
REUSED_REPOS = 2

NAMES = [k[0] for k in (*KINDS, OWNED)]
_FOUND = "array<struct<kind:int,i:int,before:int,len:int,fits:boolean,value:string>>"


def _matches(text: Column, kind: int) -> Column:
    """Every match of a kind in order: characters between it and the match before, its length, its value's hash."""
    _, pattern, group, least = (*KINDS, OWNED)[kind]
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"),
                          F.regexp_extract_all(text, p, F.lit(group)).alias("value"))

    def one(x: Column, i: Column) -> Column:
        fits = F.char_length(x["value"]) >= least
        for part in MIXED if kind == len(KINDS) else ():
            fits = fits & x["value"].rlike(part)
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), F.char_length(x["gap"]).alias("before"),
                        F.char_length(x["hit"]).alias("len"), fits.alias("fits"),
                        F.when(fits, F.sha2(x["value"], 256)).alias("value"))

    listed = F.filter(F.transform(zipped, one), lambda x: x["len"].isNotNull())
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast(_FOUND))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source",
                 owner: Column | str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_owned, n_example, n_live, n_reused, most_repos, and ``found`` (start, kind, end, example, n_repos, n_owners) by start.

    ``example`` marks values shared by at least ``EXAMPLE_OWNERS`` owners; the other
    base values, and all owned ones, count as live.  ``n_reused`` counts the live spans whose value stands in at least
    ``REUSED_REPOS`` repositories; ``most_repos`` is the largest number of repositories that share a value of the row (0: no span).
    A repository belongs to its owner: equal names under two owners are two.
    """
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unknown = lambda c: F.coalesce(as_column(c).cast("string"), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("doc_id"), unknown(repo).alias("repo"), unknown(owner).alias("owner"),
                          F.concat(*(_matches(text, k) for k in range(len(KINDS) + 1))).alias("found"))
    # Row numbers are fixed by writing them down before they are used.
    rows = materialise(scanned.select(F.monotonically_increasing_id().alias("row"), "*"), name="matches")

    each = rows.select("row", "repo", "owner", F.explode("found").alias("m")).select("row", "repo", "owner", "m.*")
    values = each.where("fits").select("value", "repo", "owner").distinct()
    # Written down, so that the join below starts from two shuffles and a hot value can be split.
    spread = materialise(values.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("n_repos"))
                         .groupBy("value").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repos").alias("n_repos")),
                         name="spread")

    in_order = Window.partitionBy("row", "kind").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("before") + F.col("len")).over(in_order).cast("int")).where("fits")
    placed = placed.select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")
    judged = placed.join(spread, "value").withColumn("example", F.col("n_owners") >= EXAMPLE_OWNERS)

    own = F.col("kind") == len(KINDS)
    so_far = Window.partitionBy("row").orderBy("start", "kind")
    inside = F.coalesce(F.max(F.when(~own, F.col("end"))).over(so_far) > F.col("start"), F.lit(False))
    after = so_far.rowsBetween(1, Window.unboundedFollowing)
    crossed = F.coalesce(F.min(F.when(~own, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    chosen = judged.withColumns({"inside": inside, "crossed": crossed}).where(
        ~own | ~(F.col("inside") | F.col("crossed") | F.col("example")))
    spans = chosen.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "example", "n_repos", "n_owners"))).alias("found"))

    out = rows.select("row", "doc_id").join(spans, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean,n_repos:bigint,n_owners:bigint>>"))
    names = F.array(*map(F.lit, NAMES))
    as_text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(
        ":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")
    base = F.filter("found", lambda x: x["kind"] < len(KINDS))
    number = lambda test: F.size(F.filter("found", test)).cast("long")
    of_kind = lambda k: number(lambda x: x["kind"] == k)
    return out.select("doc_id", "row", found.alias("found")).select(
        "doc_id", *(of_kind(k).alias(f"n_{name}") for k, name in enumerate(NAMES)),
        F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"),
        number(lambda x: x["example"]).alias("n_example"), number(lambda x: ~x["example"]).alias("n_live"),
        number(lambda x: ~x["example"] & (x["n_repos"] >= REUSED_REPOS)).alias("n_reused"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["n_repos"])), F.lit(0)).alias("most_repos"), "found")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | str = "source",
                 owner: Column | str = "source") -> DataFrame:
    """``docs`` with every span replaced: ``[SECRET]``, or ``[EXAMPLE]`` for a widely copied value.

    No row goes.  Ids should be unique; of rows that repeat an id, each is masked by the
    spans found in a row with that id and an equal text.
    """
    key, marked, places, changed_col = (unused(docs.columns, n) for n in ("key", "marked", "places", "changed"))
    named = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash")).alias(key)
    spans = secret_spans(docs.select("*", named), key, text_col, repo, owner)
    marks = (spans.where(F.size("found") > 0).select(F.col("doc_id").alias(marked), F.col("found").alias(places))
             .dropDuplicates([marked]))
    joined = docs.select("*", named).join(marks, F.col(key).eqNullSafe(F.col(marked)), "left")
    text = F.col(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.when(x["example"], "[EXAMPLE]").otherwise("[SECRET]")
        between = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.when(x["start"] >= acc["at"], F.concat(between, mark)).otherwise(F.lit(""))).alias("out"),
            x["end"].alias("at")))

    masked = F.when(F.col(places).isNull(), text).otherwise(F.aggregate(
        places, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))))
    columns = [masked.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    changed = joined.select(*columns, F.col(places).isNotNull().alias(changed_col))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.when(
            F.col(changed_col), F.char_length(text_col)).otherwise(F.col("n_chars")).cast(kind))
    return changed.drop(changed_col)
