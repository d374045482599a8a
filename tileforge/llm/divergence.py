"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are counted by slices of text. Terms of up to 8 bytes become one unsigned word of 64 bits, those of up to 16 bytes
two, big-endian and padded with zeros (no term has a zero byte), and are sorted by radix, 16 bits a turn; longer ones are
byte-sorted in buckets of lengths. Runs of equal terms are then counted, so that a slice hands on one row for each term and
source. From there on counts are sums that combine before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, hot_join, small, table, text_slices

#: Documents of a language that a kept term is in; terms of a source in the report; the unit of shares.
LEAST_DOCS, MOST_TERMS, UNIT = 10, 10, 1_000_000_000
#: Bytes of text in one slice; cells (terms x sources) that one task compares at a time; sources compared with all others at a time.
SLICE, CELLS, BLOCK = 8 << 20, 1 << 20, 256

_BYTES = np.arange(256)
#: Bytes of terms (letters and all beyond ASCII), and A-Z lowered.
TERM_BYTE = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order of rows by the given uint64 columns, the first of which leads: 16 bits a turn, least ones first."""
    order = np.arange(len(words[0]))
    for column in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((column >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The up to 8 bytes from ``start`` as one big-endian word, zeros after them; ``data`` has 8 bytes to spare at its end."""
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))[start].astype(np.uint64)
    shift = (8 * (8 - np.minimum(length, 8))).astype(np.uint64)
    return np.where(length > 0, (words >> shift) << shift, np.uint64(0))


def runs(order: np.ndarray, change: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first occurrence, occurrences, documents) of each run of one term in one group; ``change`` marks rows of ``order`` where the term changes."""
    if not len(order):
        return order, order, order
    g, d = group[order], doc[order]
    new = change.copy()
    new[1:] |= g[1:] != g[:-1]
    other = new.copy()
    other[1:] |= d[1:] != d[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.r_[at, len(order)]), np.add.reduceat(other.astype(np.int64), at)


def changes(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        out[1:] |= s[1:] != s[:-1]
    out[:1] = True
    return out


def count_terms(texts: pa.Array, group: np.ndarray) -> tuple[list[np.ndarray], list[pa.Array], list[np.ndarray], list[np.ndarray]]:
    """Groups, terms, occurrences and documents of each (group, term) of the texts, in parts by length of term."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.zeros(len(body) + 24, np.uint8)
    data[: len(body)] = LOWER[body]
    inside = TERM_BYTE[data[: len(body)]]
    begins = np.zeros(len(body) + 1, bool)
    begins[offsets] = True
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    after = np.r_[inside[1:], False] if len(inside) else inside
    start = np.flatnonzero(inside & (~before | begins[:-1]))
    length = np.flatnonzero(inside & (~after | begins[1:])) + 1 - start
    doc = np.searchsorted(offsets, start, "right") - 1
    # occurrences by group, then document: the sorts by term keep that order
    order = np.argsort(group[doc], kind="stable")
    start, length, doc = start[order], length[order], doc[order]
    owner = group[doc]
    out = [], [], [], []

    def put(first: np.ndarray, n: np.ndarray, docs: np.ndarray, owners: np.ndarray, terms: pa.Array) -> None:
        for part, x in zip(out, (owners[first], terms, n, docs)):
            part.append(x)

    for width, picked in ((1, length <= 8), (2, (length > 8) & (length <= 16))):
        s, n, d, g = start[picked], length[picked], doc[picked], owner[picked]
        words = [packed(data, s + 8 * k, n - 8 * k) for k in range(width)]
        by = radix_order(words)
        first, times, docs = runs(by, changes(words, by), g, d)
        put(first, times, docs, g, cut(data, s[first], n[first]))
    longer = np.flatnonzero(length > 16)
    classes = np.ceil(np.log2(np.maximum(length[longer], 1))).astype(np.int64)
    for c in np.unique(classes):
        at = longer[classes == c]
        terms = cut(data, start[at], length[at])
        by = pc.sort_indices(terms).to_numpy()
        sorted_terms = terms.take(pa.array(by))
        change = np.r_[True, pc.not_equal(sorted_terms[1:], sorted_terms[:-1]).to_numpy(zero_copy_only=False)]
        first, times, docs = runs(by, change, owner[at], doc[at])
        put(first, times, docs, owner[at], terms.take(pa.array(first)))
    return out


def cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes of each term as an Arrow array."""
    ends = np.r_[0, np.cumsum(length)]
    places = np.repeat(start - ends[:-1], length) + np.arange(ends[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[places])])


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each source of a language, and documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in text_slices(b, 2, SLICE):
                names = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
                frame = pd.DataFrame({"lang": part.column(0).to_pandas(), "source": part.column(1).to_pandas()})
                group = frame.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                for owners, terms, n, found in zip(*count_terms(part.column(2), group)):
                    own = names.take(pa.array(first[owners]))
                    yield pa.RecordBatch.from_arrays([own.field(0), own.field(1), terms.cast(pa.large_string()).cast(pa.string()), pa.array(n), pa.array(found)], ["lang", "source", "term", "n", "docs"])

    named = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("string").alias("text"))
    counted = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT (n + 2) / (total + 2 terms))``, exact at any size."""
    return (F.lit(1) + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(units: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum of ``divergence`` over the terms of each unit, for each source of its block with every other.

    A unit is (lang, block, sources, absent, terms): the language's sources in order, the share of a term that a source does
    not have, and for a bounded number of terms the shares of the sources that have them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lang, block, sources = b.column(0)[k], b.column(1)[k].as_py(), b.column(2)[k].values
                absent = b.column(3)[k].values.to_numpy(zero_copy_only=False)
                terms = b.column(4)[k].values
                dense = np.repeat(absent[None], len(terms), axis=0)
                if len(terms):
                    cells = terms.flatten()
                    dense[pc.list_parent_indices(terms).to_numpy(zero_copy_only=False), cells.field(0).to_numpy(zero_copy_only=False)] = cells.field(1).to_numpy(zero_copy_only=False)
                for a in range(block * BLOCK, min(len(sources), (block + 1) * BLOCK)):
                    p = dense[:, a : a + 1]
                    value = ((p - dense) ** 2 // (p + dense)).sum(axis=0)
                    other = pa.array(np.flatnonzero(np.arange(len(sources)) != a))
                    n = len(other)
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * n, pa.string()), pa.array([sources[a].as_py()] * n, pa.string()), sources.take(other), pa.array(value).take(other)], ["lang", "source", "item", "value"])

    found = units.select("lang", "block", "sources", "absent", "terms").mapInArrow(run, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others, and by which terms from the language.

    A language keeps the terms that ``least_docs`` of its documents hold. Part ``pair`` has a row for every other source of the
    language, all ranks; part ``term`` the ``most_terms`` kept terms of the source that stand out most from the whole language.

    Null text, language and source are empty; every (language, source) that occurs is a group, also one without terms, and a
    language without kept terms has pairs of value 0. Repeated rows count each. Ranks order by value, then by the item's
    bytes. Texts of any length are read whole; other columns play no part; an empty table gives an empty result.

    Counts combine before they move, by (language, source, term); a hot source is no key of any join or group by itself. The
    pairs of a language are as many as its sources squared, which is the result's own size: its sources' names travel with
    units of terms, of ``CELLS`` cells each.
    """
    counted = term_counts(docs, text, lang, source)
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = durable(kept.filter(F.col("_docs") >= least_docs).drop("_docs"))
    each = kept.select("lang", "term", "lang_n", F.explode("by_source").alias("_s")).select("lang", "term", "lang_n", "_s.source", "_s.n")

    occurring = docs.groupBy(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("has"))
    whole = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["total", "has", "lang_total", "terms"])
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    parts = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.count(F.lit(1)).over(Window.partitionBy("lang")) / CELLS)).cast("long")
    groups = durable(groups.withColumn("parts", parts).withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)))

    langs = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "source", "absent"))).alias("_s"), F.max("parts").alias("parts"))
    langs = durable(langs.select("lang", F.transform("_s", lambda s: s["source"]).alias("sources"), F.transform("_s", lambda s: s["absent"]).alias("absent"), (F.col("parts") + 1).alias("_units")))
    near = small(groups) is not groups  # the languages' table holds the same names and numbers
    facts = groups.select("lang", "source", "total", "lang_total", "terms", "at", "has", "parts")
    if near:
        met = each.join(F.broadcast(facts), ["lang", "source"])
    else:
        named = [x.withColumn("_g", F.struct("lang", "source")).drop("lang", "source") for x in (each, facts)]
        met = hot_join(*named, "_g", "has", ["term"], each.count()).withColumns({"lang": F.col("_g.lang"), "source": F.col("_g.source")})
    met = met.withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))})

    standing_out = met.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = standing_out.withColumn("rank", place).filter(F.col("rank") <= most_terms)

    by_term = met.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("cells"), F.max("parts").alias("parts"))
    by_part = by_term.groupBy("lang", F.pmod(F.xxhash64("term"), F.col("parts")).alias("_part")).agg(F.collect_list("cells").alias("terms"))
    none = langs.select("lang", F.lit(-1).cast("long").alias("_part"), F.array().cast(by_part.schema["terms"].dataType).alias("terms"))
    units = by_part.unionByName(none)
    units = units.join(F.broadcast(langs), "lang") if near else hot_join(units, langs, "lang", "_units", ["_part"], langs.agg(F.sum("_units")).first()[0] or 0)
    units = units.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("sources") - 1) / BLOCK).cast("int"))))
    pairs = pair_sums(units).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(top)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
occurring AS (SELECT lang, source FROM d GROUP BY ALL),
words AS (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM d
), kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
    SELECT o.lang, o.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (l.lang_total + 2 * l.v) AS q
    FROM occurring o JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term LEFT JOIN totals t ON t.lang = o.lang AND t.source = o.source
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM terms
QUALIFY rank <= 10
"""
