"""I-Match fingerprints: hashes of a document's mid-frequency terms under random lexicons.

Document frequencies of all terms give the lexicon: terms whose share of the documents lies in a
band (a band of inverse document frequency). A document keeps its distinct terms of the lexicon,
in order; its fingerprint is one hash of them for each of several random subsets of the lexicon.
The subsets get thinner, by half every fourth: the first is the whole lexicon, so equal fingerprints mean equal kept
terms, and the thin ones still agree where texts share only part of their terms.

Everything is built-in column functions. The lexicon travels as a bit table of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import written

BAND = (0.001, 0.1)  # share of the documents that hold a term: inverse document frequency 2.3 to 6.9
SUBSETS = 40
_PER_HALF = 4  # subset k keeps a term with probability 2 ** (-k / this)
_STEP = 3  # halvings between the lists that thinner subsets are drawn from
_TABLE_BITS = 21
_SCALE = 1 << 20
_BUCKET_ROWS = 2000
_CUTS = 256


def terms(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-case words, in order. A text of other signs only is one
    term, a blank or null one has none."""
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    hashed = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))))
    bare = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    other = F.when(F.trim(bare) != "", F.array(F.xxhash64(F.lit("signs"), bare))).otherwise(F.array().cast("array<long>"))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]"), hashed).otherwise(F.coalesce(other, F.array().cast("array<long>")))


def _word(term: Column) -> Column:
    """Which long of the bit table has the term's bit, and which bit it is, from the hash's low end."""
    return F.shiftright(F.pmod(term, F.lit(1 << _TABLE_BITS)), 6).cast("int")


def bit_table(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row, `bits`: an array of longs, the bit table of the terms whose share of the documents lies in `band`.

    A term of few documents must be in two at least. There are at most (mean distinct terms of
    a document / lower share) such terms, however many documents there are, and the table has
    2**21 bits: a term outside the band has a bit by chance as often as the table is full.
    """
    low, high = band
    # Every document has the term null too, so the count of all documents comes from the same job.
    every = docs.select(F.explode(F.concat(terms(F.col("text")), F.array(F.lit(None).cast("long")))).alias("term"))
    counts = written(every.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("term").isNull()), "term-counts")
    total = counts.where(F.col("term").isNull()).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    kept = counts.where(F.col("term").isNotNull() & (F.col("n") >= F.lit(low) * total) & (F.col("n") <= F.greatest(F.lit(high) * total, F.lit(2))))
    bit = F.expr("shiftleft(1L, cast(pmod(term, 64) as int))")
    bits = kept.groupBy(_word(F.col("term")).alias("word")).agg(F.bit_or(bit).alias("bits"))
    # 2**15 numbers, whatever the corpus.
    words = docs.sparkSession.range(1 << (_TABLE_BITS - 6)).select(F.col("id").cast("int").alias("word"))
    every_word = F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    row = words.join(bits, "word", "left").agg(F.sort_array(F.collect_list(every_word)).getField("bits").alias("bits"))
    return written(row, "lexicon")


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> Column:
    """The bit table as a constant array. It stands in every text of every plan it is used in, which
    fills the driver's memory; `bit_table(...).scalar()` does not, but has no place inside a lambda."""
    packed = ",".join(map(str, bit_table(docs, band).first().bits))
    return F.split(F.lit(packed), ",").cast("array<long>")


def _known(found: Column, table: Column) -> Column:
    """Terms of the lexicon."""
    return F.filter(found, lambda term: F.getbit(F.get(table, _word(term)), F.pmod(term, F.lit(64)).cast("int")) == 1)


def _drawn(k: int, limit: int):
    return lambda term: F.pmod(F.xxhash64(term, F.lit(k)), F.lit(_SCALE)) < limit


def _hashes(kept: Column, thin: list[list[Column]]) -> Column:
    """One hash of the kept terms for each random subset of the lexicon, null where none is in it."""
    out = []
    for k in range(SUBSETS):
        halvings, own = k // _PER_HALF, k % _PER_HALF
        base = min(halvings // _STEP, len(thin))
        source = thin[base - 1][own] if base else kept
        limit = round(_SCALE * 2 ** (base * _STEP - k / _PER_HALF))
        drawn = source if limit == _SCALE else F.filter(source, _drawn(k, limit))
        # A subset without terms has the hash of the empty list, known beforehand.
        none = F.xxhash64(F.lit(k), F.array().cast("array<long>"))
        out.append(F.nullif(F.xxhash64(F.lit(k), drawn), none))
    return F.array(*out)


def with_hashes(rows: DataFrame, text: str, name: str, table: Column) -> DataFrame:
    """`rows` with the subset hashes of the column `text`. Each step is a column of its own, so that
    nothing is computed twice; thin subsets are drawn from lists that are thinner already, one list
    for each subset of a halving."""
    rows = rows.withColumn("_terms", terms(F.col(text))).withColumn("_table", table)
    rows = rows.withColumn("_known", _known(F.col("_terms"), F.col("_table"))).drop("_table")
    # Where a text has no term of the lexicon, all its terms are kept.
    rows = rows.withColumn("_kept", F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_terms"))).drop("_terms", "_known")
    before = ["_kept"] * _PER_HALF
    thin = []
    for n in (1, 2):
        now = [f"_thin{n}{own}" for own in range(_PER_HALF)]
        for own in range(_PER_HALF):
            seed = SUBSETS + _PER_HALF * n + own
            rows = rows.withColumn(now[own], F.filter(before[own], _drawn(seed, _SCALE >> _STEP)))
        thin.append(now)
        before = now
    hashed = _hashes(F.col("_kept"), [[F.col(c) for c in own] for own in thin])
    return rows.withColumn(name, hashed).drop("_kept", *thin[0], *thin[1])


def written_out(hashes: Column) -> Column:
    """The fingerprint as text: 16 hexadecimal digits a subset, `-` where it is empty."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lpad(F.hex(h), 16, "0"), F.lit("-"))), "")


def likeness(one: Column, two: Column) -> Column:
    """Share of the subsets whose hashes agree, of those in which either text has terms; 1 if there
    is none. A subset counts the more the thinner it is: dense ones agree for equal terms only,
    while one that holds a single term of both texts agrees as often as they share their terms."""
    weights = F.array(*[F.lit(2.0 ** (k / _PER_HALF)) for k in range(SUBSETS)])
    found = F.arrays_zip(one.alias("a"), two.alias("b"), weights.alias("w"))
    seen = F.filter(found, lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    agreed = F.filter(seen, lambda x: x["a"] == x["b"])

    def weight(subsets: Column) -> Column:
        return F.aggregate(subsets, F.lit(0.0), lambda total, x: total + x["w"])

    return F.when(F.size(seen) == 0, 1.0).otherwise(weight(agreed) / weight(seen))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, text and fingerprint of every document. A null text is empty; equal texts have equal
    fingerprints. Other columns are not read; an empty table gives no rows."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_hashes(given, "text", "hashes", bit_table(given, band).scalar())
    return found.select("doc_id", "text", written_out(F.col("hashes")).alias("fingerprint"))


def _buckets(docs: DataFrame) -> Column:
    """Number of a range of doc_id with about `_BUCKET_ROWS` documents, ascending; null ids: -1.
    Ranges between 256 quantiles are cut into parts of equal width."""
    cuts = F.percentile_approx("doc_id", [k / _CUTS for k in range(_CUTS + 1)], 10_000).alias("cuts")
    known = docs.agg(cuts, F.count(F.lit(1)).alias("n")).collect()[0]
    cuts = sorted(set(known.cuts or [0]))
    parts = max(1, -(-known.n // (len(cuts) * _BUCKET_ROWS)))
    at = F.expr(f"greatest(size(filter(array({','.join(f'{c}L' for c in cuts)}), c -> c <= doc_id)) - 1, 0)")
    lows = F.array(*[F.lit(c).cast("long") for c in cuts])
    widths = F.array(*[F.lit(max(1, -(-(b - a) // parts))).cast("long") for a, b in zip(cuts, [*cuts[1:], cuts[-1] + 1])])
    part = F.least(F.greatest(F.floor((F.col("doc_id") - F.get(lows, at)) / F.get(widths, at)), F.lit(0)), F.lit(parts - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(at.cast("long") * parts + part).cast("long")


def with_next(docs: DataFrame, derive, *columns: str) -> DataFrame:
    """Rows of `derive(docs)`, each with `columns` of the next document as `next_*`: descending
    doc_id, nulls last, ties by text; after the last comes the first.

    Rows meet in buckets of neighbouring ids, one shuffle of the texts. The first document of each
    bucket, one per bucket, is found by its id, derived again and given to the bucket before.
    """
    bucket = _buckets(docs)
    ids = docs.select("doc_id", bucket.alias("_bucket")).groupBy("_bucket").agg(F.max("doc_id").alias("_head"))
    ids = written(ids, "bucket-heads")  # its size is known then: while it is small, no text moves for it
    heads = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_head")))
    heads = heads.groupBy("_bucket", "doc_id").agg(F.min("text").alias("text"))
    here = F.struct(*columns)
    heads = derive(heads).select("_bucket", here.alias("_first"))
    links = ids.withColumn("_after", F.lead("_bucket").over(Window.orderBy(F.desc("_bucket"))))
    top = ids.agg(F.max("_bucket")).scalar()
    links = links.select(F.col("_bucket").alias("_of"), F.coalesce("_after", top).alias("_bucket"))
    jumps = links.join(heads, "_bucket").select(F.col("_of").alias("_bucket"), "_first")

    rows = derive(docs).withColumn("_bucket", bucket)
    inside = Window.partitionBy("_bucket").orderBy(F.desc_nulls_last("doc_id"), F.col("text"))
    near = rows.withColumn("_next", F.lead(here).over(inside))
    # One jump a bucket, joined on what the rows are dealt by already: their texts stay where they are.
    out = near.join(jumps, "_bucket", "left").withColumn("_next", F.coalesce("_next", "_first"))
    named = [F.col("_next").getField(c).alias(f"next_{c}") for c in columns]
    return out.select(*[c for c in rows.columns if c != "_bucket"], *named)


def edited_fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all)
    of the next document, see `with_next`. Returns doc_id, n_chars, text, edited, fingerprint,
    edited_fingerprint, near_edited and near_next. Nulls and ties as in `fingerprints`.
    """
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    table = bit_table(given, band).scalar()
    rows = with_next(given, lambda rows: with_hashes(rows, "text", "hashes", table), "text", "hashes")
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left("text", size - half), F.left("next_text", half))
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("edited", edited).drop("next_text")
    rows = with_hashes(rows, "edited", "edited_hashes", table)
    return rows.select(
        "doc_id", "n_chars", "text", "edited", written_out(F.col("hashes")).alias("fingerprint"),
        written_out(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
