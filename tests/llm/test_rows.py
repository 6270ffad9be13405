"""Archives, mixing, URL lists and the rule ledger."""

import gzip
import hashlib
import io
import json
import math
import re
import struct
import zipfile
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phasemesh import scratch
from phasemesh.llm import mixing, queries, rules, store, urls, warc

# --- archives ---------------------------------------------------------------------------------------------------------


def reader(data):
    return lambda n, at: data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_central_directory(zip64):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
        with z.open("a/b.bin", "w", force_zip64=zip64) as f:
            f.write(b"hello")
        z.writestr("packed", "x" * 100, zipfile.ZIP_DEFLATED)
    data = buf.getvalue()
    found = {m.name: m for m in warc.members(reader(data), len(data))}
    at = warc.stored_at(reader(data), found["a/b.bin"])
    assert data[at : at + found["a/b.bin"].size] == b"hello"
    with pytest.raises(ValueError):
        warc.stored_at(reader(data), found["packed"])


def test_zip64_end_records():
    """A file whose end record refers to the 64-bit ones for everything."""
    name, body = b"m", b"stored bytes"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    start = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, start + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + body + central + end64 + locator + end
    (m,) = warc.members(reader(data), len(data))
    at = warc.stored_at(reader(data), m)
    assert (m.name, m.size, data[at : at + m.size]) == ("m", len(body), body)
    for bad in (b"nothing", data[:-22] + end[:4] + end[4:], end):
        if bad is not data and bad != data:
            with pytest.raises(ValueError):
                warc.members(reader(bad), len(bad))


def test_records_round_trip(spark, tmp_path):
    big, other = "<p>é</p>" * 400, "\r\n\r\nWARC/1.1" * 200
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (9, "http://c", big), (4, "u", other), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (None, "u", big), (9, "http://c", big), (None, "u", "n" * 2000)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, URL2 int").withColumnRenamed("URL2", "HTML")
    archives = warc.write(df.repartition(3), f"file://{tmp_path}/w")
    got = warc.read(archives, payload=True).collect()
    want = []
    for i, url, html in rows:
        p = (html or "").encode()
        revisit = html == big and i != 9
        want.append((i, None if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url), len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None, None if revisit else p))
    assert sorted(map(lambda r: tuple(bytes(v) if isinstance(v, bytearray) else v for v in r), got), key=str) == sorted(want, key=str)
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_small_ranges(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, "u", f"{k} " * k) for k in range(60)], "page_id long, url string, html string")
    archives = warc.write(df, f"file://{tmp_path}/w")
    monkeypatch.setattr(warc, "RANGE_BYTES", 200)
    assert sorted(r.payload_bytes for r in warc.read(archives).collect()) == sorted(len(f"{k} " * k) for k in range(60))


def test_payloads_over_a_range(spark, tmp_path):
    """Payloads larger than a range, that pack well and badly."""
    rng = np.random.default_rng(0)
    noise = rng.integers(97, 123, warc.RANGE_BYTES + 999).astype(np.uint8).tobytes().decode()
    rows = [(1, "u", "a"), (2, "u", noise), (3, "u", "0" * 40_000_000), (4, "u", "b")]
    archives = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read(archives).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}


def http(body):
    return b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body


def foreign(kind, block, *lines, form="application/http;msgtype=response"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *lines, f"Content-Type: {form}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """Several WARC files, indexes of other names and forms, records of all kinds, with other digests or none."""
    hexa = hashlib.sha1(b"two").hexdigest()
    files = {
        "archive/one.warc.gz": [foreign("warcinfo", b"software: x", form="application/warc-fields"), foreign("response", http(b"one"))],
        "archive/two.warc.gz": [foreign("response", http(b"two"), f"WARC-Payload-Digest: sha1:{hexa.upper()}"), foreign("response", http(b"2b"), "WARC-Payload-Digest: sha256:00"), foreign("revisit", http(b""))],
        "archive/three.warc.gz": [foreign("resource", b"three\r\n\r\nrest", form="text/plain"), foreign("request", b"GET / HTTP/1.1\r\n\r\n", form="application/http;msgtype=request")],
        "archive/plain.warc": [foreign("response", http(b"plain"))],
    }
    path = tmp_path / "x.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        index = {"a.cdxj": [], "b.cdxj.gz": [], "c.cdxj": []}
        for name, records in files.items():
            packed = [r if name.endswith(".warc") else gzip.compress(r) for r in records]
            z.writestr(name, b"".join(packed))
            at = 0
            for p in packed:
                line = json.dumps({"offset": str(at), "length": str(len(p)), "filename": name.removeprefix("archive/" if "two" in name else "")})
                if name != "archive/three.warc.gz":  # no index names it
                    index["a.cdxj" if "one" in name else "b.cdxj.gz" if "two" in name else "c.cdxj"].append(f"org,x)/ 2020 {line}")
                at += len(p)
        z.writestr("indexes/a.cdxj", "!meta {}\n" + "\n".join(reversed(index["a.cdxj"])))
        z.writestr("indexes/b.cdxj.gz", gzip.compress("\n".join(index["b.cdxj.gz"]).encode()) + gzip.compress(b"\n"))
        z.writestr("indexes/c.cdxj", "\n".join(index["c.cdxj"]) + "\n", zipfile.ZIP_DEFLATED)
    archives = spark.createDataFrame([(f"file://{path}",)], "archive string")
    got = sorted((r.record_type, r.payload_bytes, bytes(r.payload) if r.payload is not None else None, r.payload_digest) for r in warc.read(archives, payload=True).collect())
    sha = lambda b: hashlib.sha1(b).hexdigest()
    want = [("response", len(b), b, sha(b)) for b in (b"one", b"two", b"2b", b"plain")]
    want += [("revisit", None, None, None), ("warcinfo", 11, b"software: x", sha(b"software: x")), ("resource", 13, b"three\r\n\r\nrest", sha(b"three\r\n\r\nrest")), ("request", 0, b"", sha(b""))]
    assert got == sorted(want)
    lost = tmp_path / "lost.wacz"
    with zipfile.ZipFile(lost, "w") as z:
        z.writestr("indexes/a.cdxj", '! {"offset": 0, "length": 3, "filename": "gone.warc.gz"}')
    with pytest.raises(ValueError):
        list(warc.spans(reader(lost.read_bytes()), lost.stat().st_size))


@pytest.mark.parametrize("limit", [0, 500_000])
def test_digests_broadcast_and_joined(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
    df = spark.createDataFrame([(k, "u", "x" * (2000 + k % 5)) for k in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(df, f"file://{tmp_path}/w")).collect()}
    assert got == {k: None if k >= 35 else 35 + k % 5 for k in range(40)}


def test_damage_is_noticed():
    data = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n", b"PAYLOAD\r\n"))


# --- mixing -----------------------------------------------------------------------------------------------------------


def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c < u and k < 1000:
        k += 1
        p *= rate / k
        c += p
    return k


def uniform(seed, doc_id):
    return (int(hashlib.md5(f"{seed}:{doc_id}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48


def test_draws_equal_inversion(spark):
    df = spark.createDataFrame([(k, "x" * 10, "a" if k % 4 else "b") for k in range(400)], "doc_id long, text string, source string")
    weights = {"a": 1.0, "b": 9.0}
    rate = {"a": 4000 * 0.1 / 3000, "b": 4000 * 0.9 / 1000}
    got = Counter(r.doc_id for r in mixing.replicate(df, weights, seed=3).collect())
    for k in range(400):
        assert got.get(k, 0) == poisson(uniform(3, k), rate["a" if k % 4 else "b"])
    rates = {r.source: r.rate for r in mixing.rates(df, weights).collect()}
    assert rates == pytest.approx(rate)


def test_large_rates_are_split(spark):
    df = spark.createDataFrame([(k, "x", "a") for k in range(50)] + [(99, "y" * 5000, "b")], "doc_id long, text string, source string")
    rows = mixing.replicate(df, {"a": 1.0}, seed=1).collect()
    assert {r.source for r in rows} == {"a"} and abs(len(rows) - 5050) < 6 * math.sqrt(5050)
    assert max(r.part for r in rows) == math.ceil(5050 / 50 / mixing.PART)
    assert len({(r.doc_id, r.part, r.copy) for r in rows}) == len(rows)


def test_the_mixing_query_shuffles_whole_documents(spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda spark: f"file://{tmp_path}")
    rows = queries.op2_poisson_mix(spark, tiny).collect()
    (made,) = tmp_path.glob("mixed-*")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    files = [spark.read.parquet(str(p)).collect() for p in sorted(made.glob("*.parquet"))]
    held = [r for f in files for r in f]
    assert [(r.doc_id, r.source, r.part, r.copy, r.shuffle_key) for r in held] == [tuple(r) for r in rows]  # in shuffled order
    assert all(r.text == texts[r.doc_id] for r in held) and any(r.text for r in held)


def test_sources_broadcast_and_joined(spark, docs, monkeypatch):
    d = docs("a b c", None, "", "long " * 900, "a b c", ids=[0, 1, None, 3, 0])
    want = [tuple(r) for r in mixing.replicate(d, epochs=4.0, seed=2).collect()]
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert [tuple(r) for r in mixing.replicate(d, epochs=4.0, seed=2).collect()] == want and len(want) > 3


@pytest.mark.parametrize("limit", [0, 1000])
def test_rows_are_picked_out_by_either_join(spark, docs, monkeypatch, limit):
    monkeypatch.setattr(store, "BROADCAST_IDS", limit)
    d = docs("a", "b", "c", "d", ids=[1, 2, 2, None], extra=False)
    assert sorted(r.text for r in store.semi(d.select("doc_id", "text"), spark.createDataFrame([(2,), (5,)], "doc_id long"), "doc_id").collect()) == ["b", "c"]


def test_mixing_odd_rows(spark, docs):
    d = docs("a b c", None, "", "long " * 9000, "a b c", ids=[0, 1, None, 3, 0])
    rows = mixing.replicate(d, alpha=1.0, epochs=3.0, seed=2).collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    same = Counter(r.doc_id for r in mixing.replicate(d.repartition(3), alpha=1.0, epochs=3.0, seed=2).collect())
    assert same == Counter(r.doc_id for r in rows)
    assert mixing.replicate(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(d, {"s0": -1.0})


# --- URLs -------------------------------------------------------------------------------------------------------------

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("a.net", "/x/y", "allow"), ("a.net", "/x", "block"), ("a.net", "/", "allow"), ("org", "/", "allow"), ("org", "/", "block")]


def plain_judge(url):
    host, path = "", ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h.split(".")), len(p), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


parts = st.sampled_from(["com", "example", "net", "a", "org", "EXAMPLE", "xcom", "", "é"])
url = st.one_of(
    st.none(),
    st.text(max_size=20),
    st.builds(lambda s, h, p, q: f"{s}://{'.'.join(h)}{p}{q}", st.sampled_from(["http", "", "a://b"]), st.lists(parts, max_size=4), st.sampled_from(["", "/", "/en/", "/en/7", "/en/71/x", "/en", "/x/y/z", "/x/yz", "/xy", "//", "/x\n/y"]), st.sampled_from(["", "?a=/b", "#/en/", "?", "/tail"])),
)


@settings(max_examples=300, deadline=None)
@given(url)
def test_trie_equals_plain_search(u):
    host, path = urls.split_url(u)
    rule, verdict = urls.Trie(RULES).find(host, path) or (None, "allow")
    assert (host, path, rule, verdict) == plain_judge(u)


def test_join_equals_trie(spark, monkeypatch):
    rows = [(None, None), (1, "http://Example.COM/en/72?x"), (1, "http://Example.COM/en/72?x"), (2, "x"), (3, "a://b.a.net/x/yz#f"), (4, "http://org/"), (5, "http://" + "a." * 300 + "com/en/")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, HOST int")
    want = sorted((*[r[0]], *plain_judge(r[1])) for r in rows[1:])
    got = urls.judge(df, RULES)
    assert sorted(tuple(r) for r in got.collect() if r.page_id is not None) == want
    monkeypatch.setattr(urls, "MAX_TRIE_CHARS", 3)
    for hot in (1_000_000, 2):  # suffixes of two URLs and more are spread over many keys
        monkeypatch.setattr(urls, "HOT", hot)
        assert sorted(map(tuple, urls.judge(df, RULES).collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert urls.judge(df.limit(0), RULES).count() == 0
    for bad in ([("a", "", "maybe")], [("", "/", "block")]):
        with pytest.raises(ValueError):
            urls.Trie(bad)


def test_many_rules_of_one_host():
    """A look takes as many steps for 100,000 paths of one host as for ten."""
    trie = urls.Trie([("h.com", f"/{k:05d}", "block") for k in range(100_000)] + [("h.com", "/1234", "allow"), ("h.com", "/0", "allow")])
    assert trie.find("h.com", "/12345/x") == ("h.com/12345", "block")
    assert trie.find("a.h.com", "/1234x") == ("h.com/1234", "allow") and trie.find("h.com", "/0x") == ("h.com/0", "allow")
    assert trie.find("h.com", "/x") is None
    node = trie.top[0]["com"][0]["h"][1][1][""]
    assert list(node[2]) == [5, 4, 1]  # the lengths that are looked up


# --- rules ------------------------------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a b c", "\x85 \u00a0 \u2003x", "line\nline\n line\nline\r\n\n", "#*$%&|<> 👩‍👧 é", "one two three four five six seven eight " * 2, "a " * 30, "a b c d e f g h x a b c d e f g h", "w" * 100_000, " ".join(f"w{i % 700}" for i in range(9000)), "THE END OF " * 9 + "it"]


def test_measurements(spark, docs):
    rows = rules.apply(rules.ledger(docs(*TEXTS, *TEXTS[:3], ids=[*range(len(TEXTS)), None, None, 0]))).collect()
    want = Counter((i, *measured(t)) for i, t in zip([*range(len(TEXTS)), None, None, 0], [*TEXTS, *TEXTS[:3]]))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.failed == 0) and (r.policy, r.policy_version) == ("default", 1)
        assert r.alone == next((x.name for x in rules.RULES if r.failed == 1 << x.bit), None)
    assert rules.ledger(docs("a").limit(0)).count() == 0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n|")), max_size=120), min_size=1, max_size=6))
def test_measurements_of_random_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(df).collect()}
    assert got == {i: measured(t) for i, t in enumerate(texts)}


def test_policies_and_ablations(spark, docs):
    entries = rules.ledger(docs(*TEXTS)).cache()
    lenient = rules.Policy("lenient", 2, ("few_words", "upper_case"))
    failed = [r.failed for r in entries.collect()]
    table = {(r.policy, r.without): (r.kept_docs, r.dropped_by_it_alone) for r in rules.ablations(entries, (rules.DEFAULT, lenient)).collect()}
    bits = {r.name: 1 << r.bit for r in rules.RULES}
    for r in rules.apply(entries, lenient).collect():  # the base rules count under any policy
        assert r.kept == (r.failed & 67 == 0) and r.alone == {1: "few_words", 2: "repeated_windows", 64: "upper_case"}.get(r.failed & 67)
    for p in (rules.DEFAULT, lenient):
        for without in (None, *p.rules):
            mask = p.mask & ~bits.get(without, 0)
            kept = [f for f in failed if f & mask == 0]
            assert table[p.name, without] == (len(kept), sum(1 for f in kept if f & p.mask))


def test_ledger_is_native(spark, docs, capsys):
    rules.apply(rules.ledger(docs("a"))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_queries_equal_sql(same_as_sql):
    from phasemesh.llm import queries

    for name, sql in queries.ORACLES.items():
        same_as_sql(queries.QUERIES[name], sql)


# --- what is left behind ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_a_query_leaves_nothing_but_its_result(name, spark, tiny, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "root", lambda spark: f"file://{tmp_path}")
    assert queries.QUERIES[name](spark, tiny).count() > 0
    left = [p.name for p in tmp_path.iterdir()]
    assert len(left) <= 1 and all("-result-" in n for n in left)
