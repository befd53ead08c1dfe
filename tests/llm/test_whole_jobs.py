"""Cases in which an operator once did less than its whole job."""

import random
import string

import numpy as np

from ratecraft.llm import embed_dedup, pseudo_lm, secret_scan


def test_a_group_above_the_leaf_size_is_one_group(spark):
    """Near copies whose codes are equal share a leaf in every tree."""
    draw = np.random.default_rng(3)
    one = draw.standard_normal(32)
    x = np.concatenate([one + 1e-7 * draw.standard_normal((300, 32)), draw.standard_normal((50, 32))])
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(docs, leaf=64, max_leaf=100, max_rounds=2).collect()}
    assert {(got[k].n_links, got[k].component_id) for k in range(300)} == {(299, 0)}
    assert all(got[k].n_links == 0 for k in range(300, 350))


def test_lost_pairs_are_audited_apart_from_a_hot_group_and_then_found(spark, monkeypatch):
    """One deep tree and no rounds lose most of 20 pairs, while the links of one
    group are nearly all links."""
    monkeypatch.setattr(embed_dedup, "trees_for", lambda *_: 1)
    draw = np.random.default_rng(4)
    one, lone = draw.standard_normal(32), draw.standard_normal((20, 32))
    x = np.concatenate([one + 1e-7 * draw.standard_normal((200, 32)), lone, lone + 0.25 * draw.standard_normal((20, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[200:].sum() >= 20
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = docs.selectExpr("vec_id as node", "1 as copies", "embedding")
    hot = spark.createDataFrame([(k, 199) for k in range(200)], "node long, linked long")
    assert embed_dedup.audit(nodes, hot, 0.9, 8, 512) < 0.1
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(
        docs, leaf=1e-9, trees=1, rounds=0, max_rounds=0, block=50).collect()}
    assert [got[k].n_links for k in range(len(x))] == near.sum(axis=1).tolist()


def test_rounds_find_links_beyond_the_leaves(spark):
    """One tree and one random deal find a part of the planted links; each of
    three rounds adds more, and the whole operator finds all of them."""
    draw = np.random.default_rng(6)
    x = np.concatenate([(c + 0.2 * draw.standard_normal((12, 32))) for c in draw.standard_normal((60, 1, 32))] + [draw.standard_normal((800, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = embed_dedup.nodes_of(embed_dedup.numbered(docs))[1]
    pairs = embed_dedup.table(embed_dedup.leaf_lists(nodes, len(x), threshold=0.9, k=8, trees=1, leaf=32, max_leaf=500), "start")
    found = embed_dedup.table(embed_dedup.candidates(pairs, 0.9).distinct(), "start-candidates")
    lists, longer = embed_dedup.best_of(pairs, None, 8, 0.9)
    links = [embed_dedup.exact(found, nodes, 0.9).count()]
    for k in range(3):
        lists, longer, found, gain = embed_dedup.refined(lists, longer, found, nodes, threshold=0.9, k=8, reverse=16, name=f"test-{k}")
        links.append(embed_dedup.exact(found, nodes, 0.9).count())
    assert links == sorted(links) and links[0] < links[1], links
    assert links[0] < 0.9 * near.sum() / 2 and links[3] >= 0.95 * near.sum() / 2, (links, near.sum() / 2)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(docs, leaf=32, trees=1).collect()}
    assert sum(got.values()) >= 0.99 * near.sum()


def test_trees_grow_with_the_depth():
    assert [embed_dedup.trees_for(d, 0.9, 0.95) for d in (0, 1)] == [1, 2]
    assert embed_dedup.trees_for(14, 0.9, 0.95) > embed_dedup.trees_for(8, 0.9, 0.95) > 4


def drawn(seed, alphabet, n):
    draw = random.Random(seed)
    return "".join(draw.choice(alphabet) for _ in range(n))


def test_parts_of_credentials_are_masked_to_their_ends():
    masked = lambda t: secret_scan.mask(t, secret_scan.find(t)[1])
    both = string.ascii_letters + string.digits
    name, long = "ASIAIOSFODNN7EXAMPLE", drawn(1, both, 900)
    assert masked(f"{name} {long} end") == "[key_id] [key_secret] end"
    place = "https://db.example.com/" + "x" * 400
    assert masked(f"{place} {long} end") == "[endpoint] [key_secret] end"
    for key in (drawn(2, string.ascii_uppercase + "234567", 32) + "======", drawn(3, string.ascii_lowercase + string.digits, 30)):
        assert masked(f"https://db.example.com/x {key} end") == "[endpoint] [key_secret] end"
    for label in ("ID=", "Id: "):
        assert masked(f"{label}{'zq12' * 30} {long} end") == "[key_id] [key_secret] end"
    # an identifier's form does not hide a secret that has its endpoint
    assert masked(f"https://db.example.com/x sk_{drawn(4, both, 30)} end") == "[endpoint] [key_secret] end"


def test_a_part_does_not_confirm_itself():
    for alone in (drawn(2, string.ascii_uppercase + "234567", 32), "https://db.example.com/" + drawn(3, string.ascii_letters + string.digits, 40)):
        assert secret_scan.find(f"see {alone} here")[1] == []


def test_confirmation_apart_matches_all_pairs():
    draw = random.Random(2)
    for _ in range(300):
        spans = sorted((s, s + draw.randint(5, 60), draw.choice(secret_scan.KINDS)) for s in (draw.randint(0, 900) for _ in range(8)))
        weak = [s for s in spans if s[2] not in secret_scan.BASE_KINDS]
        fits = [w for w in weak if any(secret_scan.ROLE[o[2]] in secret_scan.COMPLEMENTS[secret_scan.ROLE[w[2]]]
                                       and 0 <= max(o[0] - w[1], w[0] - o[1]) <= 100 for o in spans)]
        assert secret_scan.confirmed([s for s in spans if s not in weak], weak, 100, apart=True) == fits


def test_parts_of_one_url_complement_each_other():
    secret = drawn(5, string.ascii_letters + string.digits, 32)
    of = lambda t: [(k, t[a:b]) for a, b, k in secret_scan.find(t)[1]]
    assert of(f"dsn postgres://admin:{secret}@db.example.com:5432/prod here") == [
        ("key_id", "admin"), ("key_secret", secret), ("endpoint", "db.example.com:5432")]
    assert of(f"post to https://hooks.example.com/services/T00/B00/{secret}.") == [
        ("endpoint", "hooks.example.com"), ("key_id", "T00"), ("key_id", "B00"), ("key_secret", secret)]
    number = "0123456789abcdef" * 2                     # a base span inside the url is its secret
    assert of(f"https://h.example.com/hook/A17/{number}") == [("endpoint", "h.example.com"), ("key_id", "A17"), ("hex", number)]
    text = f"dsn postgres://admin:{secret}@db.example.com:5432/prod here"
    assert secret_scan.mask(text, secret_scan.find(text)[1]) == "dsn postgres://[key_id]:[key_secret]@[endpoint]/prod here"
    for alone in ("https://a.example.com/T00/B00/list", "https://user:ab@h.example.com/x", "http://user@h.example.com/" + "word" * 9,
                  "https://a.example.com/C4/My-Long-Title-of-2023-and-More", "see://", "://", "https://@"):
        assert of(f"see {alone} here") == []


def test_a_host_of_many_labels_is_an_endpoint():
    secret = drawn(6, string.ascii_letters + string.digits, 40)
    host = ".".join("abcdefghij") + ".example.com:5432"
    found = secret_scan.find(f"{host} {secret}")[1]
    assert [k for _, _, k in found] == ["endpoint", "key_secret"] and found[0][:2] == (0, len(host))


def test_spelling_keeps_every_triple(spark):
    """More kinds of triples than any bound of the broadcast table: the rarest were
    dropped, and their words scored as unseen."""
    letters = [chr(c) for c in range(97, 123)] + [chr(c) for c in range(0x430, 0x4A0)]
    draw = random.Random(6)
    words = list({"".join(draw.choices(letters, k=40)) for _ in range(30_000)} | {chr(0x4e00 + k) + chr(0x5e00 + 7 * k % 9000) for k in range(9000)}
                 | {a + b + c for a in map(chr, range(33, 127)) for b in map(chr, range(33, 127)) for c in map(chr, range(33, 97))})
    code, _ = pseudo_lm.triples([w.encode() for w in words])
    kinds, n = np.unique(code, return_counts=True)
    assert len(kinds) > 1 << 18
    got = pseudo_lm.spelling(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), [])
    assert (got.codes == kinds).all() and (got.counts == n).all()
