"""Each operator against a brute-force version, a round trip or held-out data."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from ratecraft.llm import (binary, embed_dedup, mixing, packing, pseudo_lm, quality, secret_scan, simhash, tokens, url_filter, warc)
from ratecraft.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups_of(n, links):
    top = list(range(n))
    for a, b in sorted(links):
        x, y = top[a], top[b]
        top = [min(x, y) if t in (x, y) else t for t in top]
    return top


# --- quality rules

def naive_base(text):
    w = WORD.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def naive_distance(p, q):
    keys = set(p) | set(q)
    sp, sq = sum(p.values()), sum(q.values())
    total = 0.0
    for k in keys:
        a, b = p.get(k, 0) / sp, q.get(k, 0) / sq
        total += sum(x / 2 * math.log2(2 * x / (a + b)) for x in (a, b) if x)
    return math.sqrt(max(0, total))


def naive_class(c):
    if ord(c) > 127:
        return 7
    return (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace()
            else 6 if c in "#*$%&|<>" else 5)


def naive_chance(reference, n):
    """Expected divergence of n words drawn from a reference."""
    total, out = sum(reference.values()), 0.0
    for m in reference.values():
        q = m / total
        for k in range(n + 1):
            p = k / n
            out += math.comb(n, k) * q ** k * (1 - q) ** (n - k) * ((p * math.log2(2 * p / (p + q)) if p else 0) + q * math.log2(2 * q / (p + q))) / 2
    return out


@pytest.mark.parametrize("max_broadcast", [1000, 0])
def test_quality_matches_brute_force(some_docs, max_broadcast):
    docs = {r.doc_id: r for r in some_docs.collect()}
    words, shares = {}, {}
    for r in docs.values():
        w = [x.lower() if x.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(r.text)]
        words.setdefault(r.lang, Counter()).update(w)
        if len(w) >= 50:
            hist = Counter(map(naive_class, r.text))
            shares.setdefault(r.lang, []).append([hist[k] * 1000 // len(r.text) for k in range(8)])
    judged = 0
    for r in quality.judge(some_docs, max_broadcast=max_broadcast).collect():
        text, lang = docs[r.doc_id].text, docs[r.doc_id].lang
        base = naive_base(text)
        assert tuple(r[1:6]) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        if base[0] < 50:
            assert r.class_distance is None
            continue
        median = {k: sorted(s[k] for s in shares[lang])[(len(shares[lang]) - 1) // 2] for k in range(8)}
        by_class = naive_distance(Counter(map(naive_class, text)), median)
        common = dict(sorted(((w, n) for w, n in words[lang].items() if w.isalpha()), key=lambda x: (-x[1], x[0]))[:64])
        reference = common | {None: sum(words[lang].values()) - sum(common.values())}
        own = Counter(w.lower() if w.lower() in common else None for w in WORD.findall(text))
        by_word = naive_distance(own, reference)
        assert r.class_distance == pytest.approx(by_class, abs=1e-9) and r.word_distance == pytest.approx(by_word, abs=1e-9)
        step = int(2 ** (math.floor(4 * math.log2(base[0]) + 1e-9) / 4))
        chance, most = naive_chance(reference, step), naive_distance({None: 1}, reference) ** 2
        way = (by_word ** 2 - chance) / (most - chance)
        assert r.word_way == pytest.approx(way, abs=1e-6)
        bad = by_class > 0.35 or way >= 0.8 + 0.2 * 50 / base[0] or (by_class > 0.18 and way > 0.4)
        assert r.kept == (not r.base_failed and not bad)
        judged += 1
    assert judged > 40


def test_quality_rejects_what_is_not_of_its_language(spark):
    """Documents of four languages, and texts that only look like them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect())
    draw = random.Random(1)
    made = lambda letters, n: " ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(n))
    german = [r.text for r in docs.where("lang = 'de' and length(text) > 1500").orderBy("doc_id").limit(8).collect()]
    french = [r.text for r in docs.where("lang = 'fr' and length(text) > 1500").orderBy("doc_id").limit(8).collect()]
    odd = [(-1, made("0123456789", 300), "en"), (-2, made("abcdefghilmnoprstu", 300), "en"), (-3, made("qxzjkvwy", 300), "en"),
           (-4, made("qxzjkvwy", 300), "rare")] + [(-10 - k, t, "en") for k, t in enumerate(german)]
    sound = [(-100 - k, t, ["rare", None][k % 2]) for k, t in enumerate(french)]
    rows = docs.unionByName(spark.createDataFrame(odd + sound, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in quality.judge(rows).collect()}
    clean = [r for i, r in got.items() if labels.get(i) == 1 and not r.base_failed]
    junk = [r for i, r in got.items() if labels.get(i) == 0 and not r.base_failed]
    junk_texts = {r.doc_id for r in docs.collect() if labels.get(r.doc_id) == 0}
    assert not any(got[i].kept for i, _, _ in odd)
    assert all(got[i].kept for i, t, _ in sound if got[i].n_words >= 50 and not got[i].base_failed and i not in junk_texts)
    assert sum(r.kept for r in clean) >= 0.995 * len(clean) > 200
    assert sum(r.kept for r in junk) <= 0.1 * len(junk)


# --- SimHash

def naive_print(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(some_docs):
    docs = sorted((r.doc_id, naive_print(r.text)) for r in some_docs.collect())
    links = [(i, j) for i, (_, a) in enumerate(docs) for j, (_, b) in enumerate(docs[:i]) if (a ^ b).bit_count() <= 4]
    top = groups_of(len(docs), links)
    for r in simhash.near_duplicates(some_docs).collect():
        assert r.fp % 2**64 == docs[r.doc_id][1] and r.component_id == docs[top[r.doc_id]][0]


@pytest.mark.parametrize("max_shard", [4096, 6])
def test_links_connect_what_all_links_connect(spark, max_shard):
    draw = random.Random(3)
    values = set()
    for _ in range(12):
        center = draw.getrandbits(64)
        for _ in range(25):
            x = center
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            values.add(x)
    values = sorted(values)
    rows = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.links(rows, max_shard=max_shard).collect()
    place = {simhash.signed(v): k for k, v in enumerate(values)}
    got = [(place[r.a], place[r.b]) for r in found]
    assert all((values[a] ^ values[b]).bit_count() <= 4 for a, b in got)
    every = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4]
    assert groups_of(len(values), got) == groups_of(len(values), every)


def test_bk_tree_search_is_complete():
    draw = random.Random(4)
    values = list({draw.getrandbits(10) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in range(0, 1024, 37):
        assert sorted(tree.values[k] for k in tree.near(v, 2)) == sorted(x for x in values if (x ^ v).bit_count() <= 2)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [3, 100, 201]


# --- secret scans

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def test_base_spans_match_the_contract():
    draw = random.Random(1)
    bits = ["token", "Api_Key", "secret", ":", "=", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "abc", "é", "\n", "PASSWD",
            "x" * 8, "0123", "\u212a", "ſecret"]
    for _ in range(4000):
        x = "".join(draw.choice(bits) for _ in range(draw.randint(0, 25)))
        want = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
        assert secret_scan.find(x)[0] == sorted(want, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[2])))


def test_weak_parts_count_only_together():
    key, name, place = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY", "ASIAIOSFODNN7EXAMPLE", "https://db.example.com/x"
    for alone in (key, name, place, f"{name} {place}", key + " " * 300 + name):
        assert secret_scan.find(f"see {alone} here")[1] == []
    kinds = lambda t: [k for _, _, k in secret_scan.find(t)[1]]
    assert kinds(f"{name} / {key}") == ["key_id", "key_secret"]
    assert kinds(f"{place} {key}") == ["endpoint", "key_secret"]
    assert kinds(f"{key} " * 2 + name) == ["key_secret", "key_secret", "key_id"]


def test_confirmation_matches_all_pairs():
    draw = random.Random(2)
    for _ in range(300):
        spans = []
        for _ in range(draw.randint(0, 8)):
            s = draw.randint(0, 900)
            spans.append((s, s + draw.randint(5, 60), draw.choice(secret_scan.KINDS)))
        base = [s for s in spans if s[2] in secret_scan.BASE_KINDS]
        weak = sorted(s for s in spans if s not in base)
        fits = [w for w in weak if any(secret_scan.ROLE[o[2]] in secret_scan.COMPLEMENTS[secret_scan.ROLE[w[2]]]
                                       and max(o[0] - w[1], w[0] - o[1]) <= 100 for o in spans)]
        assert secret_scan.confirmed(base, weak, 100) == fits


def test_masked_text(spark):
    docs = spark.createDataFrame([(1, 'a token = "abcdef123456" b', 27), (2, "clean", 5)], "doc_id long, text string, n_chars int")
    rows = {r.doc_id: r for r in secret_scan.masked(docs).collect()}
    assert rows[1].text == 'a [assign]" b' and rows[1].n_chars == len(rows[1].text) and rows[2].text == "clean"


# --- mixing

def test_mix_schedule(some_docs):
    m = mixing.mix(some_docs, block_words=16)
    schedule, sources = m.schedule.collect(), {r.src: r for r in m.sources.collect()}
    size = {r.doc_id: len(WORD.findall(r.text)) for r in some_docs.collect()}
    assert sum(s.target for s in sources.values()) == pytest.approx(1.5 * sum(size.values()))
    for src, s in sources.items():
        own = sorted((x for x in schedule if x.src == src), key=lambda x: x["slot"])
        assert [x["rank"] for x in own] == list(range(s.slots))
        assert sum(x.n_words for x in own) == s.quota == round(s.target) <= 2 * s.words
        assert all(x.n_words == 16 for x in own if x.block < s.blocks - 1 and x["rank"] < s.slots - 1)
    # low discrepancy: after any number of slots each source has about its share
    n, total = len(schedule), sum(s.slots for s in sources.values())
    order = [x.src for x in sorted(schedule, key=lambda x: (x["slot"], x.src))]
    for src, s in sources.items():
        seen = np.cumsum([x == src for x in order])
        assert np.abs(seen - np.arange(1, n + 1) * s.slots / total).max() < 6
    for r in m.taken().collect():
        s = sources[r.src]
        want = sum(max(0, min(r.size, s.quota - e * s.words - r.start)) for e in range(2))
        assert r.taken == want and r.size == size[r.doc_id]


def test_sources_without_words(spark):
    rows = [(1, "", "z"), (2, "a b c", "y"), (3, None, "z"), (4, "d e f g h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.mix(docs).taken().collect()}
    assert got == {1: (0, 0, 0), 3: (0, 0, 0), 2: (3, 6, 6), 4: (5, 6, 6)}
    none = docs.where("doc_id in (1, 3)")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(none).taken().collect()} == {(0, 0, 0)}
    assert mixing.mixed_documents(none).count() == 0


def test_mixed_documents_hold_the_taken_words(some_docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(some_docs).taken().collect()}
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    got = Counter()
    for r in mixing.mixed_documents(some_docs).collect():
        assert texts[r.doc_id].startswith(r.text.rstrip()) and r.n_chars == len(r.text)
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == {k: v for k, v in taken.items() if v}


# --- packing and records

def ids_of(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("path, keeps_space", [(tokens.WORD_BPE, False), (tokens.BYTE_BPE, True)])
def test_segments_give_the_ids_of_whole_texts(path, keeps_space):
    draw = random.Random(3)
    bits = ["a", "é", "É", "'s", "'ll", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "\u2028", "1", "23", "...", "<|endoftext|>", "Ä", "ß",
            "日本", "\u0301", "Σ", "\x85", "\r\n", "🙂", "word"]
    own, whole = tokens.Encoder(path, keeps_space), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids + [2], text


def test_pieces_hold_every_id_once(some_docs):
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    pieces = packing.pack(some_docs, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids_of(tokens.WORD_BPE, texts[doc_id])
        assert all(a.start + a.length == b.start for a, b in zip(own, own[1:])) and own[0].doc_tokens == sum(p.length for p in own)
    assert sorted(by_doc) == sorted(texts) and sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    assert all(sum(p.length for p in own) == 256 for k, own in by_sequence.items() if k < len(by_sequence) - 1)
    done = packing.sequences(packing.pack(some_docs, capacity=256), capacity=256).collect()
    assert {len(s.ids) for s in done[:-1]} == {1024} and len(done) == len(by_sequence)


def test_hilbert_neighbours_are_adjacent():
    cells = np.array([(i >> 6 & 7, i >> 3 & 7, i & 7) for i in range(512)])
    key = packing.hilbert_key(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def slow_crc32c(message):
    r = 0xFFFFFFFF
    for b in message:
        r ^= b
        for _ in range(8):
            r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def test_crc32c():
    assert binary.crc32c([b"123456789", bytes(32)]).tolist() == [0xE3069283, 0x8A9136AA]
    draw = random.Random(5)
    messages = [draw.randbytes(n) for n in (4, 5, 9, 1023, 1024, 1025, 3000, 2048)]
    assert binary.crc32c(messages).tolist() == list(map(slow_crc32c, messages))


def test_records_round_trip(some_docs):
    texts = {r.doc_id: r.text for r in some_docs.collect()}
    manifest = binary.write(some_docs)
    at = 0
    for r in sorted(binary.read_back(manifest).collect(), key=lambda r: r.doc_id):
        ids = ids_of(tokens.BYTE_BPE, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = manifest.orderBy("shard").first()
    fs, path = binary.open_store(shard.path)
    index = binary.open_store(shard.index_path)[1]
    order = [p for part in binary.records(fs, path, index) for p in part]
    assert [p for part in binary.records(fs, path, index, chosen=[2, 0]) for p in part] == [order[2], order[0]]
    raw = bytearray(fs.open_input_file(path).read())
    raw[20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        binary.parse(bytes(raw), 1, "x")
    assert struct.unpack_from("<Q", raw)[0] == len(order[0])


# --- WARC

def test_loser_tree_merges():
    draw = random.Random(6)
    for _ in range(200):
        lists = [sorted(draw.choices(range(50), k=draw.randint(0, 9))) for _ in range(draw.randint(1, 9))]
        assert [lists[w][k] for w, k in warc.LoserTree(lists)] == sorted(x for part in lists for x in part)


def test_archives_round_trip(spark):
    from pyspark.sql import functions as F
    html = {k: [None, "", "same", f"own {k}", "é" * (k + 1)][k % 5] for k in range(40)}
    rows = [(k, f"http://H{k % 3}.x/{k % 7}\n?q" if k % 11 else None, t, "extra") for k, t in html.items()] + [(None, "http://n.x/", "null id", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, origin string").withColumn(
        "captured", F.timestamp_seconds(F.coalesce("page_id", F.lit(5))))
    for at_least, last in ((0, {"": 36, "same": 37}), (3, {"same": 37})):
        found = warc.merged_index(warc.capture_runs(warc.write(pages.repartition(5), min_bytes=at_least))).collect()
        order = sorted(found, key=lambda r: (r.part, r.seq))
        assert [(r.urlkey, r.captured) for r in order] == sorted((r.urlkey, r.captured) for r in order)
        assert len({r.run for r in found}) > 1 and len(found) == 41
        for r in found:
            if r.page_id is None:
                assert (r.record_type, r.refers_to, r.payload_bytes) == ("response", None, 7)
                continue
            text = html[r.page_id] or ""
            first = last.get(text, r.page_id)
            assert r.payload_bytes == len(text.encode())
            assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    empty = pages.limit(0)
    assert warc.merged_index(warc.capture_runs(warc.write(empty))).count() == 0


# --- url filter

def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x#y", "https://example.com/en/", "https://a.example.com/en/x", "http://x.net/fr/1", "http://x.net/de/1",
            "http://net", "no scheme", None, "", "http://com?x/y", "ftp://É.COM#/en/", "http://notexample.com/en/", "x://a://b/c"]
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(0, urls[0], None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, label int")).collect()}
    want = [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
            ("a.example.com", "/en/x", "example.com/en/", "block"), ("x.net", "/fr/1", "net/fr/", "block"), ("x.net", "/de/1", None, "allow"),
            ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("com", "", None, "allow"),
            ("É.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("a:", "//b/c", None, "allow")]
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(urls))] == want
    empty = spark.createDataFrame([], "page_id long, url string, label int")
    assert url_filter.judge(empty).count() == 0


def test_templates_generalise_merge_and_reject(spark):
    draw = random.Random(1)
    rows = []
    for k in range(600):
        section = draw.choice(["news", "blog", "wiki", "spam"])
        slug = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=9))
        rows.append((k, f"https://a.org/{section}/{slug}/{k}", draw.choice([None, 0 if section == "spam" else 1])))
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, label int"), limits=url_filter.Limits(merge_rate=0.3)).collect()
    by = {r.template: r.verdict for r in found}
    assert by == {"/+/*/0": "allow", "/spam/*/0": "block"}
    bad = [(u.split("/")[3], label) for _, u, label in rows if label is not None]
    n, b = sum(s == "spam" for s, _ in bad), sum(s == "spam" and x == 0 for s, x in bad)
    base = (sum(x == 0 for _, x in bad) + 1) / (len(bad) + 2)
    host = (sum(x == 0 for _, x in bad) + 4 * base) / (len(bad) + 4)
    assert all(r.rate == pytest.approx((b + 4 * host) / (n + 4)) for r in found if r.template == "/spam/*/0")


# --- embeddings

def vectors(seed=0):
    draw = np.random.default_rng(seed)
    base = draw.standard_normal((400, 32))
    near = np.concatenate([base[k] + 0.05 * draw.standard_normal((60 if k == 0 else 4, 32)) for k in range(7)])
    return np.concatenate([base, near, base[20:25], base[20:23] * 3, [-base[0], base[1] + 1.0]])


def test_embedding_links_match_brute_force(spark):
    x = vectors()
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0, None], [float("inf")] * 32, [1.0, 2.0]]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(x)] + [(len(x) + k, v, None) for k, v in enumerate(odd)]
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int"), leaf=64, max_leaf=40, block=24).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    top = groups_of(len(x), list(zip(*np.nonzero(near))))
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()
    assert [got[k].component_id for k in range(len(x))] == top
    for k in range(len(x), len(rows)):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)


def test_embedding_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(empty).count() == 0
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, -0.0]), (7, [0.0, 1.0])]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got, key=str) == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (6, 0, 6, True), (7, 0, 7, True)], key=str)


# --- pseudo-likelihood

def test_slopes_match_differences():
    draw = np.random.default_rng(0)
    w = pseudo_lm.fresh(1792)
    w = pseudo_lm.Weights(*[a.astype(np.float64) for a in w.arrays()])
    around, target = draw.integers(0, 2049, (50, 4)), draw.integers(0, 2048, 50)
    _, grad = pseudo_lm.predict(w, around, target, slopes=True)
    for a, g in zip(w.arrays(), grad, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), a.shape)
        a[at] += 1e-5
        up = pseudo_lm.predict(w, around, target).sum()
        a[at] -= 2e-5
        down = pseudo_lm.predict(w, around, target).sum()
        a[at] += 1e-5
        assert (down - up) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-6)


def test_probabilities_of_large_and_small_scores_agree():
    small = np.random.default_rng(1).standard_normal((20, 7)).astype(np.float32)
    target = np.arange(20) % 7
    want = small[np.arange(20), target] - np.log(np.exp(small.astype(np.float64)).sum(axis=1))
    for shift in (0, 200, -200):  # the same probabilities; beyond the bounds of a plain exponential
        logs, p = pseudo_lm.soft(small + np.float32(shift), target, True)
        assert np.allclose(logs, want, atol=1e-4) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert len(pseudo_lm.soft(np.zeros((0, 7), np.float32), np.zeros(0, int), False)[0]) == 0


@pytest.mark.parametrize("known", [0, 1, 300, 1792])
def test_probabilities_add_up_to_one(known):
    w = pseudo_lm.fresh(known, 3)
    words = w.leaf.shape[0] * w.leaf.shape[1]
    assert words >= known + pseudo_lm.BUCKETS == len(w.vectors) - 1
    logs = pseudo_lm.predict(w, np.tile([[1, 2, 3, 4]], (words, 1)), np.arange(words))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_spelling_matches_a_plain_count(spark):
    counts = spark.createDataFrame([("the", 50), ("theme", 3), ("été", 2), ("a", 7), ("x", 1)], "word string, n long")
    spelled = pseudo_lm.spelling(counts, ["the"])
    three, above, two, one = Counter(), Counter(), Counter(), Counter()
    for w, n in (("theme", 3), ("été", 2), ("a", 7), ("x", 1)):
        line = [256, 256, *w.encode(), 257]
        for x, y, z in zip(line, line[1:], line[2:]):
            three[x, y, z] += n
            above[x, y] += n
            two[y, z] += n
            one[y] += n
    words = ["theme", "aa", "é", "q", "thé"]
    want = []
    for w in words:
        line, total = [256, 256, *w.encode(), 257], 0.0
        for x, y, z in zip(line, line[1:], line[2:]):
            a, b, c = pseudo_lm.MIX
            total += math.log(a * three[x, y, z] / max(1, above[x, y]) + b * two[y, z] / max(1, one[y]) + c / 257)
        want.append(total)
    assert spelled.of([w.encode() for w in words]).tolist() == pytest.approx(want)
    parts = [min(0.0, x + math.log(pseudo_lm.BUCKETS)) for x in want]
    encoder = pseudo_lm.Encoder(["the"], spelled)
    for _ in range(2):
        ids, rare = encoder.encode(["the theme aa\nTheme", None, "q THE"])
        assert rare == pytest.approx([2 * parts[0] + parts[1], 0.0, parts[3]])
        assert [len(x) for x in ids] == [4, 0, 2] and ids[0][0] == ids[2][1] == 0 and ids[0][1] == ids[0][3] == 1 + zlib.crc32(b"theme") % 256


def test_every_position_is_a_target_once():
    """Rounds of interleaved parts; counted on a stand-in for the network's step."""
    texts, seen = [[np.arange(k % 9) for k in range(40)], [np.arange(5)], [np.arange(0)]], Counter()
    original = pseudo_lm.predict

    def count(w, around, target, slopes=False):
        seen.update(map(tuple, np.column_stack([around, target]).tolist()))
        return original(w, around, target, slopes)

    pseudo_lm.predict = count
    try:
        for k in range(pseudo_lm.ROUNDS):
            pseudo_lm.train(pseudo_lm.fresh(20), texts, k)
    finally:
        pseudo_lm.predict = original
    want = Counter()
    for batch in texts:
        around, target, _ = pseudo_lm.windows(batch, 20 + pseudo_lm.BUCKETS)
        want.update(map(tuple, np.column_stack([around, target]).tolist()))
    assert seen == want and pseudo_lm.ROUNDS == pseudo_lm.MASKED


def test_network_beats_word_frequencies_on_held_out_texts(spark):
    draw = random.Random(7)
    pairs = [(f"a{k}", f"b{k}") for k in range(40)]

    def text(n):
        return " ".join(f"{x} {y}" for x, y in draw.choices(pairs, k=n))

    docs = spark.createDataFrame([(k, text(400)) for k in range(120)], "doc_id long, text string").repartition(3)
    words = pseudo_lm.vocabulary(pseudo_lm.word_counts(docs))
    weights = pseudo_lm.fit(pseudo_lm.encoded(docs, words), len(words), rounds=4, rate=0.3, masked=2, step=256)
    held = spark.createDataFrame([(0, text(500)), (1, " ".join(draw.sample(text(500).split(), 1000)))], "doc_id long, text string")
    mean = {r.doc_id: r.mean_log_probability for r in pseudo_lm.score(pseudo_lm.encoded(held, words), weights).collect()}
    assert mean[0] > math.log(1 / 80) + 0.5  # 80 equally frequent words: their frequency alone gives log 1/80
    assert mean[0] > mean[1] + 0.5  # the same words out of order


def test_noise_scores_below_clean_texts_and_a_plain_scorer_agrees(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = dict(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect())
    draw = random.Random(1)
    made = lambda letters: " ".join("".join(draw.choices(letters, k=draw.randint(3, 9))) for _ in range(300))
    noise = [(-1, made("0123456789"), None), (-2, made("abcdefghilmnoprstu"), None), (-3, made("qxzjkvwy"), None)]
    rows = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    counts = pseudo_lm.word_counts(rows)
    words = pseudo_lm.vocabulary(counts)
    spelled = pseudo_lm.spelling(counts, words)
    ids = pseudo_lm.encoded(rows, words, spelled)
    weights = pseudo_lm.fit(ids, len(words))
    got = {r.doc_id: r for r in pseudo_lm.score(ids, weights).collect()}
    texts = {r.doc_id: (r.text, r.lang) for r in rows.collect()}
    clean = sorted(got[i].mean_log_probability for i, (_, lang) in texts.items() if lang == "en" and labels.get(i) == 1 and got[i].n_words >= 50)
    assert len(clean) > 100 and all(got[k].mean_log_probability < clean[len(clean) // 20] for k in (-1, -2, -3))
    # word by word, with plain loops
    number = {w: k for k, w in enumerate(words)}
    soft = lambda scores, k: scores[k] - max(scores) - math.log(sum(math.exp(x - max(scores)) for x in scores))
    for i in [*sorted(texts)[:3], *(k for k, (t, _) in texts.items() if t and 5 < len(t) < 400)][:8]:
        tokens_ = [w.decode() for w in (texts[i][0] or "").encode().lower().split()]
        own = [number.get(w, len(words) + zlib.crc32(w.encode()) % pseudo_lm.BUCKETS) for w in tokens_]
        line = [len(weights.vectors) - 1] * 2 + own + [len(weights.vectors) - 1] * 2
        total = sum(min(0.0, float(spelled.of([w.encode()])[0]) + math.log(pseudo_lm.BUCKETS)) for w in tokens_ if w not in number)
        for k, target in enumerate(own):
            h = sum(weights.vectors[line[k + j]].astype(float) * weights.place[p].astype(float) for p, j in enumerate((0, 1, 3, 4)))
            c, m = divmod(target, weights.leaf.shape[1])
            total += soft((weights.top @ h + weights.top_bias).tolist(), c) + soft((weights.leaf[c] @ h + weights.leaf_bias[c]).tolist(), m)
        assert got[i].log_likelihood == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_average_of_partitions(spark):
    parts = [(k, k + 1, np.full(5, k, np.float32).tobytes()) for k in range(11)]
    got = pseudo_lm.averaged(spark.createDataFrame(parts, "slot long, words long, weights binary"), fan_in=3)
    assert got == pytest.approx([sum(k * (k + 1) for k in range(11)) / 66] * 5)
