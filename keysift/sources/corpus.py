"""The engine's input tables, derived from the supplied star schema.

``owners``, ``repos``, ``commits`` and ``files`` come from customer/nation, part,
lineitem and documents.  The supplied documents hold none of the thirty secret
kinds, so a synthetic credential-shaped suffix is appended to each text; values
are put together at run time from digests of the row's own key.  Every source row
is used: the modulo below picks a *shape* for a row, it never drops one.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.functions.text import sql_text
from keysift.sources.tables import arriving_files, read_table

# Fixed value: the moment of analysis for the supplied data.
AS_OF = "2001-12-01 00:00:00"


# Column types of the supplied tables: no job is spent on finding them out.
SCHEMAS = {
    "benchmark": "item_id long, text string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


class Corpus:
    """The input tables, each read only when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self._spark, f"{self._dir}/{name}.parquet", schema=SCHEMAS[name])

    def arriving_documents(self, **options) -> DataFrame:
        """The documents as a stream of files."""
        # As a pattern the name may stand for a file or a folder of files; a plain path of a stream is a folder.
        return arriving_files(self._spark, f"{self._dir}/documents.parque[t]", SCHEMAS["documents"], **options)

    @cached_property
    def owners(self) -> DataFrame:
        return owners_of(self.table("customer"), self.table("nation"))

    @cached_property
    def repos(self) -> DataFrame:
        return repos_of(self.table("part"), self.owners)

    @cached_property
    def languages(self) -> DataFrame:
        return languages_of(self.table("part"))

    @cached_property
    def topics(self) -> DataFrame:
        return topics_of(self.table("part"))

    @cached_property
    def commits(self) -> DataFrame:
        return commits_of(self.table("lineitem"))

    @cached_property
    def targets(self) -> DataFrame:
        return targets_of(self.owners, self.repos)

    @cached_property
    def files(self) -> DataFrame:
        return files_of(self.table("documents"))

    @cached_property
    def plain_files(self) -> DataFrame:
        """Files whose content is the documents' own text."""
        return files_of(self.table("documents"), suffixed=False)


def owners_of(customer: DataFrame, nation: DataFrame) -> DataFrame:
    named = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return named.select(
        F.col("c_custkey").alias("owner_id"),
        F.expr(_LOGIN.format(key="c_custkey")).alias("owner_login"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Organization").otherwise("User").alias("owner_type"),
        F.expr(f"TIMESTAMP '{AS_OF}' - make_dt_interval(int(c_custkey * 37 % 1500))").alias("owner_created_at"),
        F.expr("int(c_custkey % 40)").alias("owner_public_repos"),
        F.expr("int(floor(abs(c_acctbal))) % 500").alias("owner_followers"),
        F.expr("int(c_custkey % 25)").alias("owner_following"),
        F.expr("if(c_custkey % 2 = 0, null, concat('bio of ', c_name))").alias("owner_bio"),
        F.expr("if(c_custkey % 3 = 0, null, n_name)").alias("owner_location"))


# The login depends on the key alone, so tables that refer to an owner need no join to name it.
_LOGIN = """CASE {key} % 5 WHEN 0 THEN concat('xk', substr(md5(string({key})), 1, 8))
    WHEN 1 THEN concat('ghost-', {key}) WHEN 2 THEN concat('user-', lpad(string({key}), 7, '0'))
    WHEN 3 THEN concat('Dev-', {key}) ELSE concat('Team.', {key}) END"""


def repos_of(part: DataFrame, owners: DataFrame) -> DataFrame:
    # A part without a customer keeps its row; its name stays unknown.
    owned = part.join(owners.select("owner_id", "owner_login"), F.expr("p_partkey div 8") == F.col("owner_id"), "left")
    named = owned.withColumn("repo_name", F.expr("""concat(owner_login, '/', replace(p_name, ' ', '-'),
        CASE p_partkey % 9 WHEN 0 THEN '-stealer-logs' WHEN 1 THEN '-dump-2024' WHEN 2 THEN '-creds' ELSE '' END,
        '-', p_partkey)"""))
    return named.select(
        F.col("p_partkey").alias("repo_id"), "owner_id", "repo_name",
        F.expr("""if(p_partkey % 17 = 0, concat('https://gist.github.com/', repo_name),
                     concat('https://github.com/', repo_name))""").alias("repo_url"),
        F.expr("""CASE WHEN p_partkey % 4 = 0 THEN null WHEN p_partkey % 8 = 1 THEN '' ELSE p_name END"""
               ).alias("repo_description"),
        F.expr("CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN null WHEN 2 THEN 'master' ELSE 'main' END"
               ).alias("default_branch"),
        F.expr(f"TIMESTAMP '{AS_OF}' - make_dt_interval(int(p_partkey * 53 % 3000))").alias("repo_created_at"),
        F.expr("""CASE p_size % 8 WHEN 0 THEN 'Python' WHEN 1 THEN 'Go' WHEN 2 THEN 'Shell' WHEN 3 THEN 'JavaScript'
                  WHEN 4 THEN 'PHP' WHEN 5 THEN 'C++' WHEN 6 THEN null ELSE 'Rust' END""").alias("repo_language"),
        F.expr("int(p_size)").alias("repo_stargazers"),
        F.expr("bigint(floor(p_retailprice)) % 900").alias("repo_size_kb"))


def languages_of(part: DataFrame) -> DataFrame:
    """(repo_id, language, bytes): one to four rows per repository; every 13th has none."""
    return part.select(
        F.col("p_partkey").alias("repo_id"),
        F.expr("""inline(transform(slice(array('Python', 'Go', 'Shell', 'C'), 1, int(if(p_partkey % 13 = 0, 0,
                  1 + p_size % 4))), (l, i) -> struct(l AS language, bigint(1000 * (i + 1) + p_partkey) AS bytes)))"""))


def topics_of(part: DataFrame) -> DataFrame:
    """(repo_id, topic): none for most repositories."""
    return part.select(
        F.col("p_partkey").alias("repo_id"),
        F.expr("""explode(CASE p_partkey % 11 WHEN 0 THEN array('ctf') WHEN 1 THEN array('tools', 'python')
                  WHEN 2 THEN array('red-team', 'pentest') WHEN 3 THEN array('ctf-writeups')
                  ELSE cast(array() AS array<string>) END)""").alias("topic"))


def commits_of(lineitem: DataFrame) -> DataFrame:
    """(repo_id, file_path, ts, ...): one row per line item; several line items form a repository's history."""
    login = _LOGIN.format(key="(l_partkey div 8)")
    return lineitem.select(
        F.col("l_partkey").alias("repo_id"), _path("l_orderkey"),
        F.expr("""if(l_partkey % 4 = 0, timestamp(trunc(l_shipdate, 'MM')) + INTERVAL 2 HOURS,
                     timestamp(l_shipdate) + make_dt_interval(0, int(l_orderkey % 24)))""").alias("ts"),
        F.expr("sha1(concat_ws('-', l_orderkey, l_linenumber, l_suppkey))").alias("commit_sha"),
        F.expr("concat('s', l_suppkey)").alias("author_name"),
        F.expr(f"""CASE l_suppkey % 4 WHEN 0 THEN concat(lower({login}), '@example.com') WHEN 1 THEN null
                   ELSE concat('s', l_suppkey, '@example.com') END""").alias("author_email"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")


_REQUESTED = """CASE {0} % 4 WHEN 0 THEN array('ALL') WHEN 1 THEN
    array('RSA_PRIVATE_KEY', 'openssh_private_key', 'NO_SUCH_RULE') WHEN 2 THEN array('all')
    ELSE array('GITHUB_PAT', 'STRIPE_SECRET_KEY', 'GITHUB_PAT') END"""


def targets_of(owners: DataFrame, repos: DataFrame) -> DataFrame:
    """(target_id, raw, secret_ids): scan requests in many spellings, one per owner and repository."""
    by_owner = owners.select(F.expr("concat('o', owner_id)").alias("target_id"), F.expr("""CASE owner_id % 14
        WHEN 0 THEN owner_login WHEN 1 THEN concat('https://github.com/', owner_login)
        WHEN 2 THEN concat('https://github.com/', owner_login, '/') WHEN 3 THEN concat('github.com/', owner_login)
        WHEN 4 THEN concat('https://GITHUB.COM/', owner_login) WHEN 5 THEN concat('  ', owner_login, ' ')
        WHEN 6 THEN concat('https://gitlab.com/', owner_login) WHEN 7 THEN concat(owner_login, '.org')
        WHEN 8 THEN '' WHEN 9 THEN '   ' WHEN 10 THEN 'https://github.com/'
        WHEN 11 THEN concat('https://github.com/', owner_login, '?tab=repositories')
        WHEN 12 THEN concat('https://github.com:443/', owner_login)
        ELSE concat('https://github.com/bad ', owner_login) END""").alias("raw"),
        F.expr(_REQUESTED.format("owner_id")).alias("secret_ids"))
    by_repo = repos.select(F.expr("concat('r', repo_id)").alias("target_id"), F.expr("""CASE repo_id % 8
        WHEN 0 THEN repo_name WHEN 1 THEN concat('https://github.com/', repo_name)
        WHEN 2 THEN concat('https://github.com/', repo_name, '/tree/main/src')
        WHEN 3 THEN concat('www.github.com/', repo_name) WHEN 4 THEN concat('http://github.com//', repo_name, '/')
        WHEN 5 THEN concat('github.com/', repo_name, '/blob/main/README.md#L1')
        WHEN 6 THEN concat('https://bitbucket.org/', repo_name)
        ELSE concat(repo_name, '-gone') END""").alias("raw"),
        F.expr(_REQUESTED.format("repo_id")).alias("secret_ids"))
    return by_owner.unionByName(by_repo)


# Columns that order the commits of one repository, newest last.
COMMIT_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def files_of(documents: DataFrame, suffixed: bool = True) -> DataFrame:
    content = F.concat("text", F.lit("\n"), _suffix()) if suffixed else F.col("text")
    return documents.select(
        F.col("doc_id").alias("file_id"), F.expr("doc_id div 2").alias("repo_id"),
        _path("doc_id"), "lang", "source", content.alias("content"))


_PATHS = [".ssh/id_rsa", "tests/fixtures/key.pem", "logs/passwords.txt", "config/ssh/key", "src/app.env",
          "deploy/server.pem", "dump/cookies.txt", "examples/keys.txt", "wallet/metamask.json",
          "terraform/provision_key", "README.md"]


def _path(key: str) -> Column:
    return F.expr(f"element_at(array({', '.join(repr(p) for p in _PATHS)}), int({key} % 11) + 1)").alias("file_path")


class _Sql(str):
    """SQL text, as opposed to literal text."""


def _hex(tag: str, n: int) -> _Sql:
    digests = ", ".join(f"md5(concat('{tag}{x}-', doc_id div 80))" for x in "abc")
    return _Sql(f"substr(concat({digests}), 1, {n})")


def _blocks(tag: str, kind: str, n: int) -> _Sql:
    name = f"{kind} PRIVATE KEY".strip() + (" BLOCK" if kind == "PGP" else "")
    body = f"repeat(md5(concat('{tag}-', doc_id div 80, '-', i)), 2)"
    return _Sql(f"array_join(transform(sequence(1, {n}), i -> concat('-----BEGIN {name}-----\\n', {body}, "
                f"'\\n-----END {name}-----')), '\\n')")


def _suffix() -> Column:
    aws, aws2 = (_Sql(f"upper({_hex(tag, 16)})") for tag in ("aw", "ax"))
    shapes: list[list[str]] = [
        [_blocks("os", "OPENSSH", 1)],
        [_blocks("rs", "RSA", 12)],
        [_blocks("ec", "EC", 120)],
        [_blocks("ds", "DSA", 1)],
        [_blocks("p8", "", 3)],
        [_blocks("en", "ENCRYPTED", 1)],
        [_blocks("pg", "PGP", 10)],
        ["id:  AK" + "IA", aws, "  ;"],
        ["AWS_SECRET_ACCESS_KEY = ", _hex("as", 40)],
        ['{"type": "service_account"}'],
        ["key: AI" + "za", _hex("ga", 35)],
        ['{"client_secret": "GOC' + 'SPX-', _hex("go", 28), '"}'],
        ["AZURE_CLIENT_SECRET=", _hex("az", 36)],
        ["DefaultEndpointsProtocol=https;AccountName=acct;AccountKey=", _hex("cs", 88), ";"],
        ["gh" + "p_", _hex("gh", 36)],
        ["glp" + "at-", _hex("gl", 20)],
        ["np" + "m_", _hex("np", 36)],
        ["py" + "pi-", _hex("py", 40)],
        ["sk_" + "live_", _hex("sk", 24)],
        ["rk_" + "test_", _hex("rk", 24)],
        ["AccountSid A" + "C", _hex("tw", 32)],
        ["TWILIO_AUTH_TOKEN = ", _hex("ta", 32)],
        ["S" + "G.", _hex("s1", 22), ".", _hex("s2", 43)],
        ["xo" + "xb-", _hex("sl", 40)],
        ["https://api.telegram.org/bot123456789:", _hex("tg", 35)],
        ["mailgun key" + "-", _hex("mg", 32)],
        ["HEROKU_API_KEY=", _hex("h1", 8), "-", _hex("h2", 4), "-4", _hex("h3", 3), "-8", _hex("h4", 3), "-",
         _hex("h5", 12)],
        ["ey" + "J", _hex("j1", 20), ".", _hex("j2", 43), ".", _hex("j3", 43)],
        ["access_token = ", _hex("at", 40)],
        ["postgres://app:", _hex("pw", 12), "@db.example.com/main"],
        [_blocks("r2", "RSA", 120)],
        ["id:  AK" + "IA", aws2, "  ;\nredis://u:", _hex("rp", 10), "@cache.example.com:6379\nxo" + "xp-", _hex("sp", 30)],
        ["glp" + "at-", "0123456789abcdefghij"],
        ["AK" + "IA12345  postgres://u:short@h  ey" + "Jab.cd  xo" + "xb-123456789012"],
    ]
    texts = (", ".join(p if isinstance(p, _Sql) else sql_text(p) for p in parts) for parts in shapes)
    cases = " ".join(f"WHEN {i} THEN concat({t})" for i, t in enumerate(texts))
    return F.expr(f"CASE doc_id % 40 {cases} ELSE '' END")
