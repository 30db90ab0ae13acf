"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are the matches of a few patterns. Each candidate's value is hashed, and the hashes are
counted over the whole corpus by distinct repositories and distinct owners. A value that many
owners hold is an example that was copied (out of a manual, say), as is one that fills the repositories of
a few; else one that a single owner or two hold, and that looks random, is taken for a live credential.

Matches are found where a text has them, in its own row: the pieces between matches and the
matches themselves give the places by running sums. Texts are not shuffled, only candidates are;
counts are aggregated before each shuffle, so one value in a third of all rows is no hot key.

Cases: null and empty texts have no candidates; a null owner or repository is a value of its own;
repeated rows give a row each and count once as repository; an empty table gives an empty result;
places are code points, end exclusive; columns of the input that are not named are kept by
redact() and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.sources.shared import keep

#: kind, pattern, group of the value, least length of the value. Fixed values.
BASE = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
ADDED = [
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("url", r"://[^/\s:@]{1,256}:([^/\s:@]{1,256})@", 1, 1),
]
KINDS = [k for k, *_ in (*BASE, *ADDED)]
#: A private key from its head to its END line; where that is missing, to the end of the base64 lines. ADDED has its head only, as the SQL does.
_HEAD, _BREAK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"(?:\\[rn]|[\s\"'+,>#*|])"
PEM = (
    rf"{_HEAD}(?:(?:[^-]++|-(?!----))*+-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|(?:\s++[A-Z][A-Za-z]{{1,20}}-[A-Z][A-Za-z]{{1,20}}: [^\r\n]*+)*+(?:{_BREAK}*+[A-Za-z0-9+/=]{{16,}}+)++(?:{_BREAK}++[A-Za-z0-9+/]{{1,15}}={{0,2}}(?![^\s\"'\\]))?"
    r"|)"
)
FOUND = [*BASE, *[(k, PEM if k == "pem" else p, g, n) for k, p, g, n in ADDED]]
#: A value that so many distinct owners hold is a copied example, and one in so many repositories for each of its owners.
COPIED_BY, COPIED_IN = 3, 50
#: A live-looking value has so many different characters at least; a password, which need not be random, is dull only if it is one character again and again.
VARIETY = 8
PASSWORDS, PASSWORD_VARIETY = ("assign", "url"), 2
_RUN = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, where value is worked out once although body uses it often."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column) -> Column:
    """Sums of the values before each one. In runs, so that the work stays near linear for long arrays."""
    zero = F.lit(0)
    total = lambda a: F.aggregate(a, zero, lambda s, v: s + v)
    before = lambda a, n: total(F.slice(a, 1, n))
    starts = F.sequence(zero, F.floor((F.size(values) - 1) / _RUN).cast("int"))
    runs = F.transform(starts, lambda b: F.slice(values, b * _RUN + 1, _RUN))
    return _let(
        runs,
        lambda runs: _let(
            F.transform(runs, total),
            lambda sums: F.flatten(F.transform(runs, lambda run, b: _let(before(sums, b), lambda base: F.transform(run, lambda _, j: base + before(run, j))))),
        ),
    )


def _matches(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The kind's matches: structs of start, order, kind, end, value."""
    regex = F.lit(pattern)
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"),
        F.regexp_extract_all(text, regex, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("v"),
    )
    lengths = lambda f: F.transform(f, lambda x: F.length(x["p"]) + F.length(x["m"]))
    shape = lambda x, at: F.struct((at + F.length(x["p"])).alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), (at + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["v"].alias("value"))
    made = _let(
        F.filter(found, lambda x: x["m"].isNotNull()),
        lambda f: F.zip_with(f, _let(lengths(f), _running), shape),
    )
    kind_of = "array<struct<start:int,order:int,kind:string,end:int,value:string>>"
    return F.when(text.rlike(pattern), F.filter(made, lambda x: F.length(x["value"]) >= least)).otherwise(F.array()).cast(kind_of)


def candidates(text: Column) -> Column:
    """All matches of all kinds by start, then kind as listed."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_matches(text, i, *row) for i, row in enumerate(FOUND)]))


def _has_any(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for _, p, _, _ in FOUND])


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners of candidates (value_hash, owner, repo)."""
    repos = found.groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = repos.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"))
    return owners.groupBy("value_hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """For each row its id, row_key, spans (start, order, kind, end, verdict, n_repos, n_owners): live, copied or dull."""
    text = F.col(text_col)
    least = lambda kind: F.when(kind.isin(*PASSWORDS), PASSWORD_VARIETY).otherwise(VARIETY)
    # one key is one value however its lines are broken
    value = lambda x: F.when(x["kind"] == "pem", F.regexp_replace(x["value"], rf"{_BREAK}", "")).otherwise(x["value"])
    spans = F.transform(
        candidates(text),
        lambda x: F.struct(x["start"], x["order"], x["kind"], x["end"], F.sha2(value(x), 256).alias("value_hash"), (F.size(F.array_distinct(F.split(x["value"], ""))) >= least(x["kind"])).alias("varied")),
    )
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), spans.alias("spans"), row_key(id_col, text_col).alias("row_key")))
    found = rows.where(F.size("spans") > 0)
    each = found.select("row_key", "owner", "repo", F.explode("spans").alias("s")).select("row_key", "owner", "repo", "s.*")
    counts = ownership(each)
    live = F.when((F.col("n_owners") >= COPIED_BY) | (F.col("n_repos") >= COPIED_IN * F.col("n_owners")), "copied").when(F.col("varied"), "live").otherwise("dull")
    judged = each.drop("owner", "repo").distinct().join(counts, "value_hash").withColumn("verdict", live)
    by_row = judged.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("start", "order", "kind", "end", "verdict", "n_repos", "n_owners"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,verdict:string,n_repos:long,n_owners:long>>")
    with_spans = found.select("doc_id", "row_key").join(by_row, "row_key").select("doc_id", "row_key", "spans")
    return rows.where(F.size("spans") == 0).select("doc_id", "row_key", none.alias("spans")).unionByName(with_spans)


def row_key(id_col: str, text_col: str) -> Column:
    """What rows of the same id and text have in common."""
    return F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7(docs: DataFrame) -> DataFrame:
    """Counts and digests of scan() for each document."""
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    verdicts = lambda v: F.size(F.filter(spans, lambda x: x["verdict"] == v)).cast("long")
    return scan(docs).select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k, *_ in BASE],
        F.sha2(_listed(F.filter(spans, lambda x: x["order"] < len(BASE))), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("copied").alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with live-looking credentials replaced by mark (and n_chars made to fit); copied examples stay."""
    columns = docs.columns
    any_here = _has_any(F.col("text"))
    clean, other = docs.where(~any_here), docs.where(any_here).withColumn("__key", row_key("doc_id", "text"))
    live = F.filter("spans", lambda x: x["verdict"] == "live")
    judged = scan(docs).select(F.col("row_key").alias("__key"), live.alias("__live")).where(F.size("__live") > 0).dropDuplicates(["__key"])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        between = F.col("text").substr(acc["at"] + 1, x["start"] - acc["at"])
        out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    text = F.aggregate("__live", start, step, lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text"))))
    other = other.join(judged, "__key", "left")
    other = other.withColumn("text", F.when(F.col("__live").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = dict(docs.dtypes)["n_chars"]
        other = other.withColumn("n_chars", F.when(F.col("__live").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.unionByName(other.select(*columns))
