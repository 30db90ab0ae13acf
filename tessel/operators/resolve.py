"""Entity resolution: names against a mention, by spelling and by words, found in inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as t
from tessel.functions.udfs import sequence_score
from tessel.sources.shared import keep

LIMIT, MIN_CONFIDENCE = 5, 0.55
#: Parts of the score; and of the overlap with the description, on top. Fixed values.
SPELLING, WORDS, DESCRIPTION = 0.7, 0.3, 0.1
#: Below this ratio long texts need not have a pair of letters in common; then all names of a tenant are compared.
LEAST_RATIO = 0.72


def word_score(a: Column, b: Column) -> Column:
    """The best Jaccard similarity of the words of a variant of a with those of one of b."""
    sets = lambda v: F.filter(F.transform(v, t.tokens), lambda s: F.size(s) > 0)
    let = lambda value, body: F.transform(F.array(value), body)[0]
    best = lambda x, y: F.array_max(F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: t.jaccard(p, q)))))
    return let(sets(a), lambda x: let(sets(b), lambda y: F.coalesce(best(x, y), F.lit(0.0))))


def spelling_bound(a: Column, b: Column) -> Column:
    """What the spelling of two lists of variants can give at most: matching characters are no more than the shorter text has."""
    ratio = lambda p, q: F.lit(2.0) * F.least(F.length(p), F.length(q)) / (F.length(p) + F.length(q))
    return F.coalesce(F.array_max(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: ratio(p, q))))), F.lit(0.0))


def _scorer(min_confidence: float):
    """Adds the spelling to the rest of the score; the confidence is the score to four places as Python rounds."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["score"] = [min(1.0, SPELLING * sequence_score(list(a), list(b)) + r) if len(b) else 0.0 for a, b, r in zip(f["mv"], f["nv"], f["rest"], strict=True)]
            f = f[f["score"] >= min_confidence]
            yield f.assign(confidence=[round(s, 4) for s in f["score"]])[["mention_id", "key", "confidence"]]

    return run


# ---- candidates: pairs that can reach the threshold, by inverted lists


@cache
def shared_grams(length: int, least: float) -> int:
    """Pairs of letters that a text of this length has in common, at least, with any text that it matches with a ratio of least or more; 0: maybe none.

    A ratio of r over T letters of both texts means M >= r T / 2 matching ones and u = T - 2 M others. Matching runs are parted by
    others, so there are u + 1 of them at most, and a run of n letters has n - 1 pairs: M - u - 1 in all.
    """
    found = []
    for other in range(math.ceil(length * least / (2 - least) - 1e-9), math.floor(length * (2 - least) / least + 1e-9) + 1):
        total = length + other
        most, need = min(length, other), math.ceil(total * least / 2 - 1e-9)
        if need <= most:
            found.append(need - (total - 2 * need) - 1)
    return max(0, min(found, default=0))


def _gram_rows(rows: DataFrame, least: float) -> DataFrame:
    """tenant_id, owner, text, size, gram, at, need of rows (tenant_id, owner, text): numbered pairs of letters with their places, and single letters
    of texts so short that they, or what they may match, can do without a common pair."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        short = max((n for n in range(1, 64) if not shared_grams(n, least)), default=0)
        reach = math.floor(short * (2 - least) / least + 1e-9)
        for f in frames:
            out = []
            for tenant, owner, text in zip(f["tenant_id"], f["owner"], f["text"], strict=True):
                n, seen = len(text), {}
                need = shared_grams(n, least)
                grams = [(text[i : i + 2], i) for i in range(n - 1)] if need else []
                pairs_too = grams if need else [(text[i : i + 2], i) for i in range(n - 1)]
                for g, i in [*pairs_too, *([(c, i) for i, c in enumerate(text)] if n <= reach else [])]:
                    seen[g] = seen.get(g, 0) + 1
                    out.append((tenant, owner, text, n, f"{g}{seen[g]}", i, need))
            yield pd.DataFrame(out, columns=["tenant_id", "owner", "text", "size", "gram", "at", "need"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("tenant_id", "owner", "text").mapInPandas(run, f"tenant_id {kinds['tenant_id']}, owner {kinds['owner']}, text string, size int, gram string, at int, need int")


def spelled_alike(mentions: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """mention_id, key: all pairs of (tenant_id, owner, text) rows whose ratio may be least or more, and few others.

    Texts meet in lists of their pairs of letters. Lists are read from the rarest on: of a text that must share k of its n pairs, any partner has
    one of the n - k + 1 rarest. Lengths, places and the number of common pairs bound the ratio before it is worked out.
    """
    m, n = keep(_gram_rows(mentions, least)), keep(_gram_rows(names, least))
    often = n.groupBy("tenant_id", "gram").agg(F.count("*").alias("often"))

    def rare(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("tenant_id", "owner", "text", F.length("gram") > 2).orderBy("often", "gram"))
        n_pairs = F.col("size") - 1
        ranked = rows.join(often, ["tenant_id", "gram"], "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("place", place)
        return ranked.where((F.length("gram") <= 2) | (F.col("place") <= n_pairs - F.col("need") + 1))

    a = rare(m).select("tenant_id", "gram", F.col("owner").alias("mention_id"), F.col("text").alias("x"), F.col("size").alias("nx"), F.col("at").alias("i"), F.col("need").alias("need_x"))
    b = rare(n).select("tenant_id", "gram", F.col("owner").alias("key"), F.col("text").alias("y"), F.col("size").alias("ny"), F.col("at").alias("j"), F.col("need").alias("need_y"))
    total = F.col("nx") + F.col("ny")
    others = F.floor(total - 2 * F.ceil(total * least / 2 - F.lit(1e-9)))  # letters that may be left over
    fits = (2 * F.least("nx", "ny") >= total * least - F.lit(1e-9)) & (F.abs(F.col("i") - F.col("j")) <= others)
    return a.join(b, ["tenant_id", "gram"]).where(fits).select("mention_id", "key").distinct()


def best_of_variant(known: DataFrame, named: DataFrame, limit: int) -> DataFrame:
    """tenant_id, variant, id, name, entity_type: of the names with each variant the first limit by name and id.

    A mention with that variant has a confidence of 1 with all of them, so no others of the list can be among its best.
    """
    rows = known.select("tenant_id", "key", F.explode("nv").alias("variant")).join(named.drop("tenant_id"), "key")
    place = F.row_number().over(Window.partitionBy("tenant_id", "variant").orderBy(F.lower("name"), "id"))
    return rows.withColumn("__place", place).where(F.col("__place") <= limit).select("tenant_id", "variant", "id", "name", "entity_type")


def candidates(asked: DataFrame, known: DataFrame, min_confidence: float) -> DataFrame:
    """mention_id, key of pairs that may reach the threshold and share no variant.

    Without a common word the spelling alone must do; with a word in common of the names, or of the mention and the description, pairs meet
    in the lists of words.
    """
    words = lambda c: F.array_distinct(F.flatten(F.transform(c, t.tokens)))
    m = asked.select("tenant_id", "mention_id", "mv", words(F.col("mv")).alias("mw"))
    n = known.select("tenant_id", "key", "nv", words(F.col("nv")).alias("nw"), words(F.col("dv")).alias("dw"))
    mention_words = m.select("tenant_id", "mention_id", F.explode("mw").alias("word"), F.array_contains("mv", F.col("word")).alias("whole_m"))
    name_words = n.select("tenant_id", "key", F.explode("nw").alias("word"), F.array_contains("nv", F.col("word")).alias("whole_n"))
    # a word that is a variant on both sides is a common variant
    by_word = mention_words.join(name_words, ["tenant_id", "word"]).where("not (whole_m and whole_n)").select("mention_id", "key")
    by_description = mention_words.join(n.select("tenant_id", "key", F.explode("dw").alias("word")), ["tenant_id", "word"]).select("mention_id", "key")
    texts = lambda rows, owner, v: rows.select("tenant_id", F.col(owner).alias("owner"), F.explode(v).alias("text"))
    if min_confidence / SPELLING >= LEAST_RATIO:
        alike = spelled_alike(texts(asked, "mention_id", "mv"), texts(known, "key", "nv"), min_confidence / SPELLING)
    else:  # texts that match so little may have nothing in common that a list could hold
        alike = m.join(n, "tenant_id").select("mention_id", "key")
    return by_word.unionByName(by_description).unionByName(alike).distinct()


def resolve(entities: DataFrame, mentions: DataFrame, limit: int | None = LIMIT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """mention_id, id, name, entity_type, confidence, rank of the best entities for each mention (mention_id, tenant_id, mention).

    Names and mentions meet in inverted lists, of their variants, their words and their pairs of letters, and never all with all: names with a
    variant of the mention have a confidence of 1, and of each variant only the first names matter; the others are candidates() whose spelling is
    compared if words and lengths leave them a chance. What is the same for each name and description is worked out once.
    Blank mentions have no result. The threshold holds before rounding.
    """
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be 0 to 1")
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    limit = limit or LIMIT
    asked = mentions.withColumn("m", t.normalize("mention")).where("m <> ''").select("mention_id", "tenant_id", t.variants("m").alias("mv"))
    described = F.coalesce(F.col("description"), F.lit("")) if "description" in entities.columns else F.lit("")
    named = entities.select("tenant_id", "id", "name", "entity_type", F.struct("tenant_id", F.coalesce("name", F.lit("")).alias("name"), described.alias("about")).alias("key"))
    known = named.select("key").distinct().select("key", F.col("key.tenant_id").alias("tenant_id"), t.variants(t.normalize("key.name")).alias("nv"), t.variants(t.normalize("key.about")).alias("dv"))
    asked, known = keep(asked), keep(known.where(F.size("nv") > 0))
    same = asked.select("mention_id", "tenant_id", F.explode("mv").alias("variant")).join(best_of_variant(known, named, limit), ["tenant_id", "variant"])
    sure = same.select("mention_id", "id", "name", "entity_type", F.lit(1.0).alias("confidence")).distinct()
    pairs = candidates(asked, known, min_confidence).join(asked, "mention_id").join(known.drop("tenant_id"), "key").where(~F.arrays_overlap("mv", "nv"))
    pairs = pairs.withColumns({"w": word_score(F.col("mv"), F.col("nv")), "d": word_score(F.col("mv"), F.col("dv"))})
    pairs = pairs.where(SPELLING * spelling_bound(F.col("mv"), F.col("nv")) + WORDS * F.col("w") + DESCRIPTION * F.col("d") >= min_confidence)
    pairs = pairs.select("mention_id", "key", "mv", "nv", (F.col("w") * WORDS + F.col("d") * DESCRIPTION).alias("rest"))
    kind = "mention_id {}, key {}, confidence double".format(dict(mentions.dtypes)["mention_id"], known.schema["key"].dataType.simpleString())
    scored = pairs.mapInPandas(_scorer(min_confidence), kind).join(named, "key").select("mention_id", "id", "name", "entity_type", "confidence")
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("confidence"), F.lower("name"), "id"))
    return sure.unionByName(scored).withColumn("rank", rank).where(F.col("rank") <= limit)
