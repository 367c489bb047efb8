"""Quality rules: base counts of each text, then cross-document line frequency.

Lines are normalised (lower case, runs of white space to one space, trimmed),
hashed, and counted in distinct documents per host.  Lines above the limit, a
share of the host's documents with a small floor, are taken out, and a document that loses too much is rejected.  Copies of one text
count as one document, so that a copied article is not its own boilerplate;
removing copies is another operator's task.

All work is in DataFrame and SQL functions.

Defined cases: a null text has no words and fails; a null host is a host of its
own; rows that repeat doc_id and text get one verdict each; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents

#: A line in more than this share of a host's distinct documents is boilerplate ...
MAX_SHARE_OF_HOST = 0.05
#: ... but never one in this many or fewer.
MIN_DOCS_OF_HOST = 10
#: A document whose words outside boilerplate lines are a smaller share than this is depleted.
MIN_SHARE_LEFT = 0.3
MIN_WORDS = 50

_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
_LINES = r"filter(split(t, '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')"

#: Words inside 3-word windows that occur twice: hash each window; if any hash
#: repeats, sort (hash, place), keep the places of equal neighbours, and count
#: the words that these windows cover.  transform(array(v), v -> ...) binds a
#: computed array once, so that it is not evaluated again for each element.
_REPEATS = """
transform(array(if(size(w) < 3, array(), transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))))), h ->
  if(size(array_distinct(h)) = size(h), 0L,
    transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as i)))), s ->
      transform(array(array_sort(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), array())))))), p ->
        aggregate(zip_with(p, concat(slice(p, 2, size(p)), array(get(p, size(p) - 1) + 3)), (a, b) -> least(3, b - a)), 0L, (a, x) -> a + x)
      )[0]
    )[0]
  )
)[0]
"""


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the counts, a hash of the text, and (hash, words) of each distinct line."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return t.selectExpr(
        "doc_id",
        "host",
        "xxhash64(t) as text_hash",
        f"""transform(array({_WORDS}), w -> struct(
              cast(size(w) as long) as n_words,
              aggregate(w, 0L, (a, x) -> a + length(x)) as word_chars,
              {_REPEATS} as n_repeat_words))[0] as c""",
        "cast(regexp_count(t, '[#*$%&|<>]') as long) as n_symbols",
        f"transform(array({_LINES}), l -> cast(size(l) - size(array_distinct(l)) as long))[0] as n_dup_lines",
        rf"""transform({_LINES}, x -> transform(array(trim(regexp_replace(lower(x), '[\\x20\\x09-\\x0D]+', ' '))), y ->
              struct(xxhash64(y) as line, size(split(y, ' ')) as words))[0]) as lines""",
    ).select("doc_id", "host", "text_hash", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words", "lines")


def frequent_lines(base: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(host, line) pairs that more than ``max_docs`` and more than ``max_share`` of the distinct documents of the host have."""
    lines = (
        base.select("host", "text_hash", F.explode("lines.line").alias("line"))
        .groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one"))
        .groupBy("host", "line").agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") > max_docs)
    )
    hosts = (
        base.groupBy("host", "text_hash").agg(F.lit(1).alias("one"))
        .groupBy("host").agg(F.count("*").alias("host_docs"))
        .select(F.col("host").alias("h_host"), "host_docs")
    )
    joined = lines.join(hosts, F.col("host").eqNullSafe(F.col("h_host")))
    return joined.where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line", "n_docs")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MIN_DOCS_OF_HOST, max_share: float = MAX_SHARE_OF_HOST, min_share_left: float = MIN_SHARE_LEFT) -> DataFrame:
    """Counts and verdict of every document; words_left are those outside boilerplate lines."""
    # Rows that repeat doc_id and text lose their lines each on its own, so rows are told apart by a number.
    base = cut(base_counts(docs, doc_id, text, host).withColumn("row", F.monotonically_increasing_id()))
    frequent = cut(frequent_lines(base, max_docs, max_share)).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    # A line that is in many documents is a hot key: AQE splits it, as neither side is more than an exchange.
    lost = (
        base.select("row", "host", F.explode("lines").alias("l"))
        .join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("l.line") == F.col("f_line")))
        .groupBy("row")
        .agg(F.sum("l.words").alias("lost"))
        .select(F.col("row").alias("o_row"), "lost")
    )
    counts = base.drop("lines")
    joined = counts.join(lost, F.col("row") == F.col("o_row"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.coalesce("lost", F.lit(0)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_share_left * F.col("n_words"))).alias("kept"),
        left.alias("words_left"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
