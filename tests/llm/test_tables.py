"""Resampling, source divergence and WARC packages: odd input, and against plain versions."""

import collections
import hashlib
import io
import math
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, odd_rows
from tileforge.llm import common, divergence, exact, resampling, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MORE = SCHEMA + ", weight string, score string, rank string, term string, n string, part string, item string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *["c"] * 7) for r in odd_rows()], MORE).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], MORE)


def prose(rng, n, words=60):
    pool = ["the", "Straße", "naïve", "a", "of", "Donaudampfschifffahrtsgesellschaft", "éclair", "antidisestablishmentarian", "漢字漢字漢字", "x1y2", "B2b", "twelve-byte!", "exactlyeight", "sixteenletterwrd"]
    return [" ".join(rng.choice(pool) + ("" if rng.random() < 0.8 else str(rng.randint(0, 9))) for _ in range(rng.randint(0, words))) for _ in range(n)]


def test_text_slices_hold_all_rows():
    rng = random.Random(1)
    texts = ["é" * rng.choice([0, 1, 5, 400]) for _ in range(300)] + [None, None]
    whole = pa.record_batch([pa.array(range(302)), pa.array(texts)], ["k", "t"])
    for batch in (whole, whole.slice(17, 90), whole.slice(0, 0)):
        parts = list(common.text_slices(batch, 1, 500))
        assert [k for p in parts for k in p.column(0).to_pylist()] == batch.column(0).to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 500 for p in parts)


# resampling


def plain_draw(docs, target, grams, buckets, percent, least, seed="2024"):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, t in docs for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)]
    out, able = [], []
    for k, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'~' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(found), weight, score, None])
        if len(words) >= least:
            able.append(out[-1])
    for place, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is None, r[0]))[: percent * len(able) // 100]):
        row[4] = place + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_draw_against_a_plain_version(spark, monkeypatch, grams):
    rng = random.Random(grams)
    monkeypatch.setattr(resampling, "SLICE", 2000)
    docs = [(i, t) for i, t in enumerate(prose(rng, 400))] + [(i, t) for i, t in odd_rows_of_text()]
    target = prose(rng, 30) + [None, "", "the of the of the"]
    got = resampling.draw(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), grams=grams, buckets=97, percent=30)
    assert sorted(str(list(r)) for r in got.collect()) == plain_draw(docs, target, grams, 97, 30, 20)


def odd_rows_of_text():
    return [(1000 + i, r[1]) for i, r in enumerate(odd_rows())]


def test_draw_of_odd_rows(odd, empty, spark):
    rows = resampling.draw(odd, odd).collect()
    assert len(rows) == 16 and rows[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    assert all(r.n_features or (r.weight == 0 and r["rank"] is None) for r in rows)
    assert resampling.draw(empty, odd).count() == 0 and resampling.draw(odd, empty).count() == 16
    # ties: one text and rows repeated; ranks are 1, 2, 3 all the same
    same = spark.createDataFrame([(i // 2, "word " * 30) for i in range(60)], "doc_id long, text string").repartition(4)
    ranks = sorted(r["rank"] for r in resampling.draw(same, same, percent=50).collect() if r["rank"])
    assert ranks == list(range(1, 31))


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 25), "kept") for i in range(100)], "doc_id long, text string, rank string")
    out = resampling.drawn_rows(docs, docs)
    assert out.columns == docs.columns and out.count() == 10


# divergence


def plain_audit(docs, least):
    out, langs = [], collections.defaultdict(list)
    for text, lang, source in docs:
        langs[lang or ""].append((source or "", TERM.findall((text or "").translate(LOWER))))
    for lang, rows in langs.items():
        seen = collections.Counter(t for _, terms in rows for t in set(terms))
        kept = sorted(t for t, n in seen.items() if n >= least)
        count = collections.defaultdict(collections.Counter)
        for source, terms in rows:
            count[source].update(t for t in terms if t in seen and seen[t] >= least)
        total = sum(count.values(), collections.Counter())

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 1000000000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                for k, (v, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


@pytest.mark.parametrize("cells, block", [(1 << 20, 256), (40, 3)])
def test_audit_against_a_plain_version(spark, monkeypatch, cells, block):
    """In one piece, and with units of few cells and blocks of few sources."""
    rng = random.Random(3)
    monkeypatch.setattr(divergence, "SLICE", 3000)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "BLOCK", block)
    docs = [(t, rng.choice(["en", "de", None]), rng.choice([f"s{k}" for k in range(7)] + ["s0", "s0", None])) for t in prose(rng, 300)]
    docs += [(None, "fr", "a"), ("", "fr", "b"), ("once only", "fr", "c"), ("z" * 70000 + " " + "z" * 70000, "en", "s1")] + [("z" * 70000, "en", "s2")] * 9 + [("漢" * 40 + "-", "en", "s3")] * 11
    rng.shuffle(docs)
    got = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(4))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, 10)


def test_audit_where_groups_are_too_many_to_be_sent(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(divergence, "small", lambda df: df)
    monkeypatch.setattr(common, "KEY_ROWS", 3)
    docs = [(t, "en", rng.choice("aaab")) for t in prose(rng, 150)]
    got = divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string").repartition(4))
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, 10)


def test_audit_of_odd_rows(odd, empty):
    rows = divergence.audit(odd, least_docs=1).collect()
    want = plain_audit([(r[1], r[2], r[3]) for r in odd_rows()], 1)
    assert sorted(map(tuple, rows)) == want
    assert divergence.audit(empty).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**13 + 7, 10**15 + 3, 10**9 + 1
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def test_radix_order_is_that_of_bytes():
    rng = np.random.default_rng(1)
    terms = [bytes(rng.integers(97, 123, rng.integers(1, 17)).astype(np.uint8)) for _ in range(3000)]
    data = np.frombuffer(b"".join(terms) + b"\0" * 24, np.uint8).copy()
    length = np.array([len(t) for t in terms])
    start = np.r_[0, np.cumsum(length)[:-1]]
    words = [divergence.packed(data, start, length), divergence.packed(data, start + 8, length - 8)]
    assert [terms[k] for k in divergence.radix_order(words)] == sorted(terms)
    assert divergence.cut(data, start, length).to_pylist() == terms


# packages


def check_report(spark, folder, rows, schema="page_id long, url string, html string"):
    pages = spark.createDataFrame(rows, schema).repartition(3)
    written = warc.write_packages(warc.planned(pages), folder, package_bytes=2000, package_records=40)
    got = sorted(map(str, (tuple(r) for r in warc.page_report(warc.read_records(written, span=700)).collect())))
    first, want = {}, []
    for k, url, html, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= 100 and digest in first
        name = None if k is None else str(k)
        want.append(str((name, len(body), digest, "revisit" if again else "response", first[digest] if again else None)))
        first.setdefault(digest, name)
    assert got == sorted(want)
    return written


def test_packages_give_back_every_page(spark, tmp_path):
    rng = random.Random(7)
    texts = ["é漢 <p>" * 30, "short", "", None, "a" * 99, "b" * 100, "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "x\0y" * 50]
    rows = [(i, rng.choice([f"https://www.example.org/{i}?q=a b#é", "no url at all", None, "http://h\r\nx: y"]), rng.choice(texts + [f"only {i} " * 30])) for i in range(200)]
    rows += [rows[0], rows[5], rows[5], (None, None, texts[0]), (None, "u", "b" * 100)] + [(500 + k, None, "hot " * 60) for k in range(90)]
    written = check_report(spark, str(tmp_path / "p"), rows)
    assert written.count() > 3 and written.agg(F.sum("records")).first()[0] == len(rows)
    found = warc.members(written).collect()
    for r in found:
        with zipfile.ZipFile(r.archive.removeprefix("file:")) as z:
            info = z.getinfo(r.member)
            assert (info.compress_type, info.compress_size, info.file_size) == (r.method, r.packed, r.size)
            with open(r.archive.removeprefix("file:"), "rb") as f:
                f.seek(r.start)
                assert f.read(r.packed) == z.read(r.member)


def test_clashing_columns_and_empty_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, key string, digest string, payload string, record_type string, _hash string, n_bytes string"
    check_report(spark, str(tmp_path / "a"), [(k, "u", "page " * (k % 3 * 30), "x", "x", "x", "x", "x", "x") for k in range(9)], schema)
    written = warc.write_packages(warc.planned(spark.createDataFrame([], schema)), str(tmp_path / "b"))
    assert written.count() == 0 and warc.read_records(written).count() == 0


class Memory(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


@pytest.mark.parametrize("before, note, wide", [(b"", b"", False), (b"junk before" * 9, b"", False), (b"", b"a note", False), (b"", b"", True), (b"head", b"n", True)])
def test_directories_are_those_of_a_plain_reader(monkeypatch, before, note, wide):
    if wide:  # as if the package were too large for 32 bits
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, name in enumerate(["a.txt", "archive/é.warc", "indexes/i.cdx", "d/"]):
            z.writestr(zipfile.ZipInfo(name), b"x" * 100 * k, zipfile.ZIP_DEFLATED if k == 2 else zipfile.ZIP_STORED)
        z.comment = note
    data = before + out.getvalue()
    found = warc.zip_directory(Memory(data), len(data))
    plain = zipfile.ZipFile(io.BytesIO(data))
    assert [(n, m, p, w) for n, m, _, p, w in found] == [(i.filename, i.compress_type, i.compress_size, i.file_size) for i in plain.infolist()]
    for name, method, start, packed, _ in found:
        raw = data[start : start + packed]
        assert (zlib.decompress(raw, -15) if method else raw) == plain.read(name)


def test_faults_are_rows(spark, tmp_path):
    pages = spark.createDataFrame([(k, "http://a.b/c", f"page {k} " * 40) for k in range(6)], "page_id long, url string, html string").coalesce(1)
    good = warc.write_packages(warc.planned(pages), str(tmp_path / "p")).first().archive.removeprefix("file:")
    data = open(good, "rb").read()
    (tmp_path / "short.zip").write_bytes(data[: len(data) // 2])
    (tmp_path / "none.zip").write_bytes(b"")
    record = zlib.compressobj(wbits=31)
    one = warc.warc_record("7", None, "d", 3, "response", None, b"abc")
    one_packed = record.compress(one) + record.flush()
    with zipfile.ZipFile(tmp_path / "noindex.zip", "w") as z:
        z.writestr("archive/a.warc.gz", one_packed * 3)
        z.writestr("archive/b.warc", one * 2)
        z.writestr("archive/cut.warc.gz", one_packed + one_packed[:20])
        z.writestr(zipfile.ZipInfo("archive/c.warc.gz"), one_packed, zipfile.ZIP_DEFLATED)
        z.writestr("other/d.warc.gz", one_packed)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("short.zip", "none.zip", "noindex.zip", "absent.zip")], "archive string")
    rows = warc.read_records(paths.withColumn("archive", F.concat(F.lit("file://"), "archive"))).collect()
    assert sum(r.error is None for r in rows) == 6 and {bytes(r.payload) for r in rows if r.error is None} == {b"abc"}
    assert sum(r.error is not None for r in rows) == 5


def test_failures_are_no_results(spark, tmp_path):
    """A report that has to be whole ends at a fault; a store that cannot be read is no fault of an archive."""
    (tmp_path / "broken.zip").write_bytes(b"PK broken")
    (tmp_path / "folder.zip").mkdir()
    records = {n: lambda n=n: warc.read_records(spark.createDataFrame([(f"file://{tmp_path}/{n}.zip",)], "archive string")) for n in ("broken", "folder")}
    assert warc.page_report(records["broken"]()).count() == 0
    with pytest.raises(Exception, match="not all records could be read"):
        warc.page_report(records["broken"](), strict=True).collect()
    with pytest.raises(Exception, match="(?i)error"):
        records["folder"]()


# shared sums


@pytest.mark.parametrize("level", [10_000, 3])
def test_running_sums_of_equal_rows(spark, monkeypatch, level):
    """Overfull buckets of equal rows, a null group, and buckets added up over several levels, against plain sums."""
    monkeypatch.setattr(common, "BUCKET_ROWS", 5)
    monkeypatch.setattr(common, "LEVEL", level)
    rng = random.Random(1)
    rows = [("a", rng.random(), rng.randint(0, 3), rng.randint(0, 9)) for _ in range(300)] + [("a", 0.25, 1, 4)] * 400 + [("b", 0.5, 2, 3)] * 100 + [("b", 0.5, 1, 7)] * 90
    df = common.durable(spark.createDataFrame(rows, "g string, p double, o int, v int").repartition(5))
    got = collections.defaultdict(list)
    for r in common.running_sum(df, "g", "p", ["o", "v"], F.col("v"), 40, "before").collect():
        got[r.g].append((r.p, r.o, r.v, r.before))
    for g in "ab":
        total = 0
        assert len(got[g]) == sum(r[0] == g for r in rows)
        for p, o, v, before in sorted(got[g]):
            assert before == total
            total += v


def test_filters_in_parts_let_all_repeated_keys_pass(spark, monkeypatch):
    rows = common.durable(spark.range(4000).select((F.col("id") % 3000 * 7919).alias("k"), "id"))
    keys = common.durable(exact.repeated_keys(rows.select(F.col("k").alias("key")), 4000))
    monkeypatch.setattr(exact, "MOST_BITS", 4096)
    marked = exact.with_maybe(rows, "k", keys).collect()
    assert len(marked) == 4000 and all(r._maybe for r in marked if r.k < 1000 * 7919)
    assert sum(not r._maybe for r in marked) > 1900


def test_equal_rows_are_dealt_over_tasks(spark):
    """As planned; adaptive execution puts so few rows together again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    rows = common.durable(spark.range(60_000, numPartitions=8).select(F.lit("g").alias("g"), F.lit(0.5).alias("p"), F.lit(1).alias("o")))
    out = common.running_sum(rows, "g", "p", ["o"], F.lit(1), 60, "at")
    largest = max(out.rdd.glom().map(len).collect())
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert out.agg(F.count_distinct("at"), F.max("at")).first() == (60_000, 59_999) and largest <= 40_000
