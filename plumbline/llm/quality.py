"""Quality rules: distribution divergence against language references, with minimum lengths.

A text's histogram of character classes and its histogram of common words are compared with references of its
language (the nearest reference where the language is unknown) by the Jensen-Shannon distance, base 2. Texts below
a minimum length are not judged by a histogram, since short texts stray by chance. Basic counts go first.

All is one narrow projection of SQL functions: no shuffle, no Python. Repeated three-word windows are found within
a text by sorting packed hashes of the windows with their positions: equal upper bits mark candidates, and only
these are compared by their whole hashes.

Defined cases: a null or empty text has no words, fails the basic rule and is not kept; repeated rows give equal
rows; an empty table gives an empty result; texts of any length are read whole; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE_WORD, table

SPACE, SYMBOL = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Shares of character classes in ordinary prose, rounded by hand (lower and upper case a-z, digits, white
#: space, symbols, other than ASCII, the rest), and the most common words of a language in order of frequency.
CLASSES = {
    "en": (0.770, 0.025, 0.008, 0.170, 0.0005, 0.001, 0.0255),
    "de": (0.775, 0.045, 0.008, 0.145, 0.0005, 0.013, 0.0135),
    "fr": (0.755, 0.022, 0.008, 0.165, 0.0005, 0.027, 0.0225),
    "es": (0.765, 0.022, 0.008, 0.168, 0.0005, 0.017, 0.0195),
}
RANKED = {
    "en": "the of and to a in is that for it was on with as be at by he this from",
    "de": "der die und in den von zu das mit sich auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}
#: Shares fall with the rank by a power law (Zipf), in all languages alike.
COMMON = {lang: {w: round(0.065 / rank**0.85, 6) for rank, w in enumerate(words.split(), 1)} for lang, words in RANKED.items()}
BITS = 24  # of a position within a text, in packed hashes


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """sqrt of the Jensen-Shannon divergence of counts / total and shares, arrays of the same length."""

    def part(count: Column, q: Column) -> Column:
        p = count.cast("double") / F.greatest(total, F.lit(1)).cast("double")
        m = (p + q) / F.lit(2.0)
        own = F.when(count > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
        return own + q * F.log2(q / m)

    parts = F.aggregate(F.zip_with(counts, shares, part), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(F.lit(0.0), parts / F.lit(2.0)))


def references(lang: Column) -> Column:
    """array<struct<classes, words, shares>>: the reference of a language, or all of them if it has none."""
    one = {k: F.struct(F.array(*map(F.lit, CLASSES[k])).alias("classes"), F.array(*map(F.lit, COMMON[k])).alias("words"), F.array(*map(F.lit, (*COMMON[k].values(), 1 - sum(COMMON[k].values())))).alias("shares")) for k in CLASSES}
    out = F.array(*one.values())
    for k, c in one.items():
        out = F.when(lang == k, F.array(c)).otherwise(out)
    return out


def word_counts(common: Column, words: Column, total: Column) -> Column:
    """How often each word occurs, and how many other words there are."""
    counts = F.transform(words, lambda w: F.size(F.filter(common, lambda x: x == w)))
    return F.concat(counts, F.array(F.aggregate(counts, total.cast("int"), lambda a, x: a - x)))


def repeat_words() -> dict[str, Column]:
    """The steps from window hashes (_grams, _packed) to the number of words in repeated windows, each a column
    for the next."""
    top = lambda x: F.shiftright(x, BITS)
    at = lambda a, i: F.get(a, i)
    near = lambda a, i, key: (key(at(a, i - 1)) == key(at(a, i))) | (key(at(a, i + 1)) == key(at(a, i)))
    maybe = F.filter(F.col("_packed"), lambda x, i: F.coalesce(near(F.col("_packed"), i, top), F.lit(False)))
    maybe = F.when(F.col("n_words") < (1 << BITS), F.transform(maybe, lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))).otherwise(F.sequence(F.lit(0), F.greatest(F.size("_grams") - 1, F.lit(0))))
    whole = F.array_sort(F.transform(F.col("_maybe"), lambda p: F.struct(at(F.col("_grams"), p).alias("h"), p.alias("p"))))
    same = F.filter(F.col("_whole"), lambda x, i: F.coalesce(at(F.col("_whole"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(at(F.col("_whole"), i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(same, lambda x: x["p"]))
    steps = F.transform(F.col("_places"), lambda p, i: F.least(F.lit(3), F.coalesce(at(F.col("_places"), i + 1) - p, F.lit(3))))
    count = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return {"_maybe": maybe, "_whole": whole, "_places": places, "n_repeat_words": count}


def measure(docs: DataFrame) -> DataFrame:
    """All columns of docs, the basic counts, the two distances, and a running number _n."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"), (F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")).alias("_lang"))
    rest = F.regexp_replace("_text", "[a-z]+", "")
    own = own.withColumns({"_words": F.array_remove(F.split("_text", SPACE + "+"), ""), "_rest": rest, "_chars": F.char_length("_text")})
    window = lambda w, i: F.xxhash64(w, F.get(F.col("_words"), i + 1), F.get(F.col("_words"), i + 2))
    grams = F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), window)
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    wanted = sorted({w for words in COMMON.values() for w in words})
    own = own.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.char_length(F.array_join("_words", "")).cast("long"), "_grams": grams, "_lines": lines, "_common": F.filter("_words", lambda w: w.isin(wanted))})
    # positions fit beside the upper bits of a hash; longer texts go to the exact comparison at once
    pack = F.sort_array(F.transform("_grams", lambda h, i: F.shiftleft(F.shiftright(h, BITS), BITS).bitwiseOR(i.cast("long"))))
    own = own.withColumns({"n_symbols": F.regexp_count("_rest", F.lit(SYMBOL)).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"), "_packed": F.when(F.col("n_words") < (1 << BITS), pack)})
    for name, c in repeat_words().items():
        own = own.withColumn(name, c)
    count = lambda pattern: F.regexp_count("_rest", F.lit(pattern))
    own = own.withColumn("_classes", F.array(F.col("_chars") - F.char_length("_rest"), count("[A-Z]"), count("[0-9]"), count(SPACE), F.col("n_symbols").cast("int"), count(r"[^\x00-\x7F]")))
    own = own.withColumn("_classes", F.concat("_classes", F.array(F.aggregate("_classes", F.col("_chars"), lambda a, x: a - x))))
    own = own.withColumn("_refs", references(F.col("_lang")))
    by_class = F.transform("_refs", lambda r: js_distance(F.col("_classes"), F.col("_chars"), r["classes"]))
    by_word = F.transform("_refs", lambda r: js_distance(word_counts(F.col("_common"), r["words"], F.col("n_words")), F.col("n_words"), r["shares"]))
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in (*COUNTS, "class_distance", "word_distance", "base_failed", "kept", "_n")]
    return own.select(*kept, *COUNTS, F.array_min(by_class).alias("class_distance"), F.array_min(by_word).alias("word_distance"), F.monotonically_increasing_id().alias("_n"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEAT = 50, 50
# a text with none of its language's common words is at a word distance of 0.40, whatever its length
CLASS_WORDS, CLASS_MOST, WORD_WORDS, WORD_MOST = 50, 0.32, 100, 0.34


def verdict(class_words: int = CLASS_WORDS, class_most: float = CLASS_MOST, word_words: int = WORD_WORDS, word_most: float = WORD_MOST) -> tuple[Column, Column]:
    """(base_failed, kept) over measured columns."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    strays = ((F.col("n_words") >= class_words) & (F.col("class_distance") > class_most)) | ((F.col("n_words") >= word_words) & (F.col("word_distance") > word_most))
    return failed, ~failed & ~strays


def judge(docs: DataFrame, **limits) -> DataFrame:
    failed, kept = verdict(**limits)
    # a filter on kept must not be pushed below the projection, where each step would be worked out anew wherever it is
    # used; the optimiser does not push a predicate through a running number
    return measure(docs).withColumns({"base_failed": failed, "kept": kept & (F.col("_n") >= 0)}).drop("_n")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    wrapped = docs.select(F.struct(*docs.columns).alias("_own"), "text", *(["lang"] if "lang" in docs.columns else []))
    return judge(wrapped, **limits).where("kept").select("_own.*")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql_distance(counts: list[str], total: str, shares) -> str:
    parts = []
    for c, q in zip(counts, shares):
        p = f"(CAST({c} AS DOUBLE) / greatest({total}, 1))"
        m = f"(({p} + CAST({q!r} AS DOUBLE)) / 2)"
        parts.append(f"CASE WHEN {c} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CAST({q!r} AS DOUBLE) * log2(CAST({q!r} AS DOUBLE) / {m})")
    return f"sqrt(greatest(0, ({' + '.join(parts)}) / 2))"


def judge_sql(source: str = "documents", columns: str = "doc_id") -> str:
    """DuckDB SQL of judge(): the columns given, the counts, base_failed and kept."""
    wanted = sorted({w for words in COMMON.values() for w in words})
    by_class = {k: _sql_distance([f"c{i}" for i in range(7)], "chars", v) for k, v in CLASSES.items()}
    by_word = {}
    for k, v in COMMON.items():
        names = [f'"w_{w}"' for w in v]
        by_word[k] = _sql_distance([*names, f"(n_words - {' - '.join(names)})"], "n_words", (*v.values(), 1 - sum(v.values())))
    nearest = lambda by: "CASE lang " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in by.items()) + f" ELSE least({', '.join(by.values())}) END"
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) AS ls FROM {source}),
g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k
  FROM (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3))),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE k > 1) GROUP BY rid),
n AS (
  SELECT t.*, CAST(len(w) AS BIGINT) AS n_words, length(s) AS chars, CAST(len(regexp_replace(s, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(s, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         coalesce(r.n_repeat_words, 0) AS n_repeat_words,
         len(regexp_extract_all(s, '[a-z]')) AS c0, len(regexp_extract_all(s, '[A-Z]')) AS c1, len(regexp_extract_all(s, '[0-9]')) AS c2,
         len(regexp_extract_all(s, '{space}')) AS c3, len(regexp_extract_all(s, '{SYMBOL}')) AS c4, len(regexp_extract_all(s, '[^\x00-\x7F]')) AS c5,
         {', '.join(f"len(list_filter(w, lambda x: x = '{w}')) AS \"w_{w}\"" for w in wanted)}
  FROM t LEFT JOIN r USING (rid)),
m AS (SELECT *, chars - c0 - c1 - c2 - c3 - c4 - c5 AS c6 FROM n),
d AS (SELECT *, {nearest(by_class)} AS class_distance, {nearest(by_word)} AS word_distance,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT {columns}, {', '.join(COUNTS)}, base_failed,
       NOT base_failed AND NOT (n_words >= {CLASS_WORDS} AND class_distance > {CLASS_MOST}) AND NOT (n_words >= {WORD_WORDS} AND word_distance > {WORD_MOST}) AS kept
FROM d"""


OP2_SQL = judge_sql()
