"""Embeddings, archives, quality rules and the pipeline against plain versions."""

import gzip
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.duck import assert_same, connect
from tests.llm.cases import empty, odd_documents
from weftline.llm import neardup, packing, quality, queries, shinglejoin, warc

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(connect(SF), queries.queries()[name](spark, SF), queries.oracle_sql()[name])


def plain_quality(text):
    words = [(m.group(), m.start()) for m in WORD.finditer(text or "")]
    names = [w for w, _ in words]
    grams = [tuple(names[k : k + 8]) for k in range(len(names) - 7)]
    hit, times = set(), Counter(grams)
    for k, g in enumerate(grams):
        if times[g] > 1:
            hit |= set(range(k, k + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(names), sum(map(len, names)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_quality_rules(spark):
    more = [(100, "a b c d e f g h " * 4, "en", "s"), (101, "x\nx \nx\nx", "en", "s"), (102, " ".join(f"w{k}" for k in range(25)), None, None), (103, "é日 #\n\n é日 #", "en", "t")]
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source").union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    got = sorted(map(repr, (tuple(r[c] for c in ("doc_id", *quality.METRICS, "base_failed")) for r in quality.judge(docs).collect())))
    want = []
    for d in docs.collect():
        m = plain_quality(d["text"])
        want.append((d["doc_id"], *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(map(repr, want))
    assert quality.judge(empty(spark)).count() == 0


def hosts_case(spark):
    """40 hosts of which one fails far more often than the rest, one a little more often, and one has a single bad document."""
    good = " ".join(f"w{k}" for k in range(40))
    rng = np.random.default_rng(4)
    rows = []
    for h in range(40):
        rate = {0: 0.7, 1: 0.15}.get(h, 0.08)
        rows += [("short" if rng.random() < rate else f"{good} {h} {k}", f"host{h}") for k in range(60)]
    rows += [("short", "single"), (good, None), (None, None), ("short", None)] + [(f"{good} {k}", "hot") for k in range(1200)]
    return spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(rows)], "doc_id long, text string, source string")


def test_bad_host_takes_its_documents_along(spark):
    docs = hosts_case(spark)
    rows = quality.judge(docs).join(docs, "doc_id").collect()
    lost = {r["source"] for r in rows if not r["kept"] and not r["base_failed"]}
    assert lost == {"host0"} and not any(r["kept"] for r in rows if r["source"] == "host0")
    assert all(r["kept"] != r["base_failed"] for r in rows if r["source"] != "host0")
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality.filter_documents(docs).collect()} == kept
    assert quality.filter_documents(docs).columns == docs.columns and quality.filter_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("case", ["hosts", "one host", "all fail", "none"])
def test_quality_sql_on_hosts_that_differ(spark, case):
    docs = {"hosts": hosts_case(spark), "one host": hosts_case(spark).where("source = 'host1'"), "all fail": hosts_case(spark).where("text = 'short'"), "none": hosts_case(spark).limit(0)}[case]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert_same(con, quality.judge(docs).drop("shrunk_rate"), quality.ORACLE)


def test_prior_weighs_by_how_hosts_differ(spark):
    """Against the plain formula; hosts with one document each tell nothing and so leave the prior as heavy as it may be."""
    rng = np.random.default_rng(6)
    for n, rates in ((np.full(200, 50), rng.beta(2, 8, 200)), (np.ones(300, int), np.full(300, 0.2)), (np.full(50, 40), np.full(50, 0.2))):
        bad = rng.binomial(n, rates)
        rows = [(f"h{k}", bool(j < b)) for k, (m, b) in enumerate(zip(n, bad, strict=True)) for j in range(m)]
        got = {r["host"]: r["shrunk_rate"] for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
        mu = bad.sum() / n.sum()
        room = n.sum() - (n * n).sum() / n.sum() - len(n) + 1
        rho = ((n * (bad / n - mu) ** 2).sum() / (mu * (1 - mu)) - len(n) + 1) / room if room > 0 else 0
        weight = min(50.0, max(1.0, 1 / max(rho, 1e-9) - 1))
        assert all(got[f"h{k}"] == pytest.approx((bad[k] + mu * weight) / (n[k] + weight)) for k in range(len(n)))
        assert weight == pytest.approx(10, rel=0.5) if n[0] == 50 else weight > 25


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 48))
    near = np.concatenate([base[:20] + rng.normal(size=(20, 48)) * s for s in (0.05, 0.2, 0.4, 0.5)])
    hot = base[30] + rng.normal(size=(700, 48)) * 0.2
    x = np.concatenate([base, near, base[:5], 2 * base[5:8], hot])
    x = np.round(x, 3)
    rows = [(int(k), [float(v) for v in r]) for k, r in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 48, [None] * 48, [float("nan")] * 48, [float("inf")] + [1.0] * 47, [1.0, 2.0]]
    rows += [(n + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df.repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    links = link.sum(1)
    found = np.array([got[k]["n_links"] for k in range(n)])
    assert (found <= links).all() and found.sum() >= 0.98 * links.sum()
    comp = list(range(n))
    for _ in range(n):
        new = [min([comp[k], *(comp[j] for j in np.flatnonzero(link[k]))]) for k in range(n)]
        if new == comp:
            break
        comp = new
    same = sum(got[k]["component_id"] == comp[k] for k in range(n))
    assert same >= 0.98 * n
    for k in range(len(odd)):
        r = got[n + k]
        assert (r["n_links"], r["component_id"], r["kept"]) == (0, n + k, True)
    assert got[None]["kept"] and got[None]["n_links"] == 0
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def pairs_at(cosine, n, dimension, seed=11):
    """n random pairs of unit vectors at this cosine."""
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(2, n, dimension))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(1)[:, None] * x
    return x, cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]


@pytest.mark.parametrize("hashes,dimension,n", [(3, 2, 1500), (3, 64, 1500), (4, 64, 1500), (5, 64, 1500), (3, 768, 300), (4, 768, 300)])
def test_bucket_recall_at_the_threshold(hashes, dimension, n):
    x, y = pairs_at(0.9, n, dimension)
    tables = neardup.tables_for(hashes, neardup.padded_size(dimension))
    a, b = neardup.bucket_keys(x, tables, hashes), neardup.bucket_keys(y, tables, hashes)
    found = np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)])
    print(f"recall {found:.4f} dimension {dimension} hashes {hashes} tables {tables}")
    assert found >= 0.985


@pytest.mark.parametrize("hashes", [4, 5])
def test_more_hashes_find_all_pairs(spark, hashes):
    x, y = pairs_at(0.9 + 1e-9, 400, 64)
    u = np.concatenate([x, y])
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(u)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(df, hashes=hashes).collect()}
    links = (u @ u.T >= 0.9).sum(1) - 1
    found = np.array([got[k] for k in range(len(u))])
    assert (found <= links).all() and found.sum() >= 0.985 * links.sum()


def test_repeated_ids_keep_their_own_vectors(spark):
    x, y = pairs_at(0.97, 40, 64)
    # each id stands for a vector of one pair and one of another
    rows = [(k, v) for k, v in enumerate(x)] + [(k, v) for k, v in enumerate(x[::-1])] + [(100 + k, v) for k, v in enumerate(y)]
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in rows], "vec_id long, embedding array<double>")
    got = {}
    for r in neardup.near_duplicates(df.repartition(3)).collect():
        got.setdefault(r["vec_id"], []).append(r["n_links"])
    u = np.stack([v for _, v in rows])
    want = {}
    for (k, _), links in zip(rows, (u @ u.T >= 0.9).sum(1) - 1, strict=True):
        want.setdefault(k, []).append(int(links))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_hadamard():
    x = np.eye(8)
    h = neardup.hadamard(x)
    assert np.allclose(h @ h.T, np.eye(8)) and np.allclose(np.abs(h), 8**-0.5)


def test_chunk_framing():
    for p in (b"", b"x", b"WARC/1.1\r\n" * 9, os.urandom(20_000)):
        assert warc.unchunked(warc.chunked(p, 7)) == p
    for bad in (b"", b"5\r\nab\r\n", b"3\r\nabcde\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_records_are_framed_by_their_length():
    bodies = [b"", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9, b"\r\n\r\n", os.urandom(300_000), b"x" * 300_000]
    records = [warc.record("response", f"n{k}", b) for k, b in enumerate(bodies)]
    records[1] = records[1].replace(b"WARC/1.1", b"WARC/1.0", 1)
    whole = b"".join(records)
    for raw in (whole, gzip.compress(whole), b"".join(map(warc.member, records)), warc.SEPARATOR.encode("latin-1").join(map(warc.member, records))):
        assert [b for _, b in warc.parse_records(warc.inflated(raw))] == bodies
    assert [b for _, b in warc.parse_records(bytes([c]) for c in b"".join(records[:3]))] == bodies[:3]
    for bad in (whole[:-400], b"junk\r\n\r\n", records[0] + b"x"):
        with pytest.raises(ValueError):
            list(warc.parse_records([bad]))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.inflated(warc.member(records[3])[:-9])))


def test_other_archives(spark, tmp_path):
    """An archive as other tools write them: a member for each record, no separators, kinds that are no pages, bare HTTP bodies."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nWARC/1.1\r\nbody"
    records = [warc.record("warcinfo", "i", b"software: x"), warc.record("request", "q", b"GET / HTTP/1.1\r\n\r\n"), warc.record("response", "r", http, WARC_Payload_Digest="sha1:ABC")]
    for name, raw in (("a.warc.gz", b"".join(map(gzip.compress, records))), ("b.warc", b"".join(records)), ("c.data", b"".join(map(gzip.compress, records)))):
        (tmp_path / name).write_bytes(raw)
    got = warc.read_archives(spark, f"file://{tmp_path}", with_payload=True).collect()
    assert [bytes(r["payload"]) for r in got] == [b"WARC/1.1\r\nbody"] * 3 and {r["page_id"] for r in got} == {None}


def pages(spark):
    big = "é" * 30_000 + "WARC/1.1\r\n" + "<p>" * 9000
    html = ["x" * 200, "x" * 200, "short", "short", None, "", big, big, "a WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20, "\r\n" * 100, "日本" * 40, "y" * 100, "y" * 100, "y" * 99, "y" * 99]
    rows = [(k, f"http://h/{k}" if k % 4 else None, h, "clash") for k, h in enumerate(html)]
    rows += [rows[0], (None, "http://n\r\nWARC/1.1\r\n", "x" * 200, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives(spark, tmp_path):
    df = pages(spark)
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df.repartition(3), folder, segment=5000)
    got = warc.read_archives(spark, folder, with_payload=True).collect()
    src = [(r["page_id"], (r["html"] or "").encode()) for r in df.collect()]
    want = []
    for i, p in src:
        first = min((j for j, q in src if q == p and j is not None), default=None)
        revisit = len(p) >= 100 and first is not None and i != first
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None, None if revisit else p))
    key = repr
    assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got), key=key) == sorted(want, key=key)
    records = warc.read_records(spark, folder)
    assert records.where("type = 'continuation'").count() > 10
    named = {r["name"] for r in records.where("type = 'response'").collect()}
    revisits = records.where("type = 'revisit'").collect()
    assert revisits and {r["target"] for r in revisits} - {None} <= named and records.select("name").distinct().count() == records.count()
    # the files are gzip members to any other reader, and Spark splits them anywhere
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert sum(1 for _ in warc.parse_records([raw])) == records.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        assert warc.read_records(spark, folder).groupBy("type").count().orderBy("type").collect() == records.groupBy("type").count().orderBy("type").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archive_errors(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark), folder, segment=5000)
    records = warc.read_records(spark, folder)
    with pytest.raises(Exception, match="do not add up"):
        warc.reassemble(records.where("segment is null or segment <> 2")).select("block").collect()
    lone = warc.record("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Payload_Digest="sha256:ab", X_Refers_To_Page=5, WARC_Refers_To="<none>")
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.warc").write_bytes(lone)
    with pytest.raises(Exception, match="does not find its response"):
        warc.read_archives(spark, f"file://{tmp_path}/v").collect()
    warc.write_archives(pages(spark).limit(0), f"{folder}0")
    assert warc.read_archives(spark, f"{folder}0").count() == 0


def test_pipeline_equals_plain_stages(spark):
    """Later stages held against plain versions of what they do to their predecessor's documents."""
    import public_tokenizers

    import corpus_pipeline as c
    from tests.llm.test_join import brute
    from weftline.llm import langid

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = langid.identify(docs)
    first = c.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns
    want = {r["doc_id"] for r in known.collect() if r["lang_pred"] != "und" and r["score"] >= langid.MIN_SCORE}
    assert {r["doc_id"] for r in first.collect()} == want and len(want) > 0.9 * docs.count()
    second = c.STAGES[1][1](spark, first, sf)
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    plain = {r["doc_id"] for r in first.collect() for m in [plain_quality(r["text"])] if not (m[0] < 20 or 100 * m[4] > 30 * m[0])}
    assert set(texts) == plain
    third = c.STAGES[2][1](spark, second, sf)
    assert third.columns == docs.columns and {r["doc_id"] for r in third.collect()} == {i for i, k in brute(list(texts.items())).items() if i == k}
    want = packing.pack(third, public_tokenizers.path("word_bpe_49k.json"))
    got = c.run(spark, sf)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def five_word_classes(rows):
    """id -> smallest linked id, all pairs of five-word shingle sets compared at 0.8."""
    sets = {}
    for i, t in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*(words[k:] for k in range(5)), strict=False))
    comp = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and comp[a] != comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return comp


def test_near_duplicate_stage_takes_five_words_at_80(spark):
    import corpus_pipeline as c
    from tests.llm.test_join import corpus

    words = [f"q{k}" for k in range(100)]
    changed = " ".join("new" + w if w in ("q30", "q60") else w for w in words)
    rows = corpus()
    n = len(rows)
    rows += [(n, " ".join(words)), (n + 1, changed), (n + 2, " ".join("r" + w for w in words)), (n + 3, " ".join(["r" + w for w in words] + [f"s{k}" for k in range(20)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in c.near_duplicates(spark, docs, "").collect()}
    assert got == {i for i, k in five_word_classes(rows).items() if i == k}
    assert {n, n + 2} <= got and not {n + 1, n + 3} & got


def test_pipeline_stages_on_odd_documents(spark):
    import corpus_pipeline as c

    for make in (odd_documents, empty):
        docs = make(spark)
        for _, stage in c.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
        assert c.STAGES[-1][1](spark, docs, "").count() >= docs.count()


def test_signature_volume_is_a_fraction_of_the_set():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert len(shinglejoin.signatures(np.unique(x))) < 600
