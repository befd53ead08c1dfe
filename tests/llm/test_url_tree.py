"""The URL filter's template tree against a plain version, and what it decides."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ratecraft.llm import url_filter
from ratecraft.llm.url_filter import Limits

SCHEMA = "page_id long, url string, label int"


def naive_parts(path, limits):
    typed = re.sub(r"(?<![0-9A-Za-z])(?=[a-fA-F-]*[0-9])[0-9a-fA-F-]{16,}(?![0-9A-Za-z])", "<id>", path)
    parts = [p for p in re.sub("[0-9]+", "0", typed).split("/") if p]
    return parts if len(parts) <= limits.max_depth else parts[:limits.max_depth] + ["/".join(parts[limits.max_depth:])]


def naive_alike(children, limits):
    """``children``: name -> Counter of (below) -> [n, labelled, bad]."""
    total, bad = (sum(v[i] for c in children.values() for v in c.values()) for i in (1, 2))
    rate = (bad + 1) / (total + 2)
    info = {}
    for name, below in children.items():
        n, l, b = (sum(v[i] for v in below.values()) for i in range(3))
        share = (b + limits.prior * rate) / (l + limits.prior)
        error = limits.merge_errors * math.sqrt(share * (1 - share) / (l + limits.prior))
        apart = max(limits.merge_rate, error)
        side = 1 if share - rate > apart else -1 if rate - share > apart else 0
        info[name] = (n, share - error, share + error, side, max(below, key=lambda x: (below[x][0], x)))
    classes = []
    for key in sorted({(i[3], i[4]) for i in info.values()}):
        members = [m for m, i in info.items() if (i[3], i[4]) == key]
        pool = Counter()
        for m in members:
            pool.update({x: v[0] for x, v in children[m].items()})
        size, like = sum(pool.values()), []
        for m in members:
            p = {x: v[0] / info[m][0] for x, v in children[m].items()}
            q = {x: n / size for x, n in pool.items()}
            d = sum((a * math.log2(2 * a / (a + q[x])) for x, a in p.items()))
            d += sum(c * math.log2(2 * c / (c + p.get(x, 0))) for x, c in q.items())
            if d / 2 <= limits.merge_divergence + 1e-12:
                like.append(m)
        run, reach = [], None
        for m in sorted(like, key=lambda m: (info[m][1], m)):
            if reach is not None and info[m][1] > reach:
                classes.append(run)
                run, reach = [], None
            run.append(m)
            reach = info[m][2] if reach is None else max(reach, info[m][2])
        classes.append(run)
    out, k = {}, 0
    for run in classes:
        if len(run) > 1:
            k += 1
            out |= dict.fromkeys(run, "+" if k == 1 else f"+{k}")
    return out


def naive_templates(rows, limits):
    """url rows ``(host, path, label)`` -> per row (template, judged_by, rate, reject)."""
    first = [(host, tuple(naive_parts(path, limits))) for host, path, _ in rows]
    count = defaultdict(lambda: [0, 0, 0])
    for key, (_, _, label) in zip(first, rows):
        for i, x in enumerate((1, label is not None, label == 0)):
            count[key][i] += x
    now = {key: key[1] for key in count}
    depth = max((len(p) for p in now.values()), default=0)
    for level in range(depth):
        nodes = defaultdict(Counter)
        for key, parts in now.items():
            if len(parts) > level:
                nodes[key[0], parts[:level]][parts[level]] += count[key][0]
        for key, parts in list(now.items()):
            each = nodes.get((key[0], parts[:level]), {})
            if len(parts) > level and len(each) > limits.max_children and each[parts[level]] < limits.min_share * sum(each.values()):
                now[key] = (*parts[:level], "*", *parts[level + 1:])
    for level in range(depth):
        nodes = defaultdict(lambda: defaultdict(lambda: defaultdict(lambda: [0, 0, 0])))
        for key, parts in now.items():
            if len(parts) > level:
                for i in range(3):
                    nodes[key[0], parts[:level]][parts[level]]["/".join(parts[level + 1:])][i] += count[key][i]
        for place, children in nodes.items():
            names = naive_alike(children, limits) if len(children) > 1 else {}
            for key, parts in list(now.items()):
                if len(parts) > level and (key[0], parts[:level]) == place and parts[level] in names:
                    now[key] = (*parts[:level], names[parts[level]], *parts[level + 1:])
    own, tree, hosts = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for key, parts in now.items():
        for i in range(2):
            own[key[0], parts][i] += count[key][i + 1]
            hosts[key[0]][i] += count[key][i + 1]
            for d in range(len(parts) + 1):
                tree[key[0], parts[:d]][i] += count[key][i + 1]
    l, b = (sum(h[i] for h in hosts.values()) for i in range(2))
    base, out = (b + 1) / (l + 2), []
    for key in first:
        host, parts = key[0], now[key]
        host_rate = (hosts[host][1] + limits.prior * base) / (hosts[host][0] + limits.prior)
        steps = [(parts, own[host, parts])] + [(parts[:d], tree[host, parts[:d]]) for d in range(len(parts), -1, -1)]
        by = next(((p, x) for p, x in steps if x[0] >= limits.min_labels), None)
        rate = host_rate if by is None else (by[1][1] + limits.prior * host_rate) / (by[1][0] + limits.prior)
        out.append(("/" + "/".join(parts), None if by is None else "/" + "/".join(by[0]), rate, by is not None and rate > limits.max_bad))
    return out


def random_urls(seed, n):
    draw = random.Random(seed)
    sections = ["news", "blog", "shop", "tags", "spam", "deals"]
    rows = []
    for k in range(n):
        host = draw.choice(["a.org", "b.org", "c.org"])
        section = draw.choice(sections)
        parts = [section] + [draw.choice(["x", "y", "z", "page", draw.choice("abcdefgh") * draw.randint(1, 3), str(k)]) for _ in range(draw.randint(0, 4))]
        if draw.random() < 0.05:
            parts += ["deep"] * draw.randint(4, 12)
        bad = draw.random() < (0.9 if section in ("spam", "deals") and host != "b.org" else 0.1)
        rows.append((host, "/" + "/".join(parts), draw.choice([None, None, 0 if bad else 1])))
    return rows


@pytest.mark.parametrize("seed, limits", [(1, Limits()), (2, Limits(max_children=4, min_share=0.1, max_depth=3)), (3, Limits(merge_rate=0.0, min_labels=2))])
def test_tree_matches_a_plain_version(spark, seed, limits):
    rows = random_urls(seed, 700)
    df = spark.createDataFrame([(k, f"https://{h}{p}", label) for k, (h, p, label) in enumerate(rows)], SCHEMA)
    got = {r.page_id: r for r in url_filter.judge(df.repartition(3), limits=limits).collect()}
    want = naive_templates(rows, limits)
    for k, (template, by, rate, reject) in enumerate(want):
        assert (got[k].template, got[k].judged_by, got[k].verdict) == (template, by, "block" if reject else "allow"), (k, rows[k])
        assert got[k].rate == pytest.approx(rate)
    assert {"allow", "block"} == {r.verdict for r in got.values()}


def test_a_bad_directory_is_blocked_and_its_good_neighbour_allowed(spark):
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows = [(k, f"https://x.org/spam/{w}.html", 0) for k, w in enumerate(words[:60])]
    rows += [(100 + k, f"https://x.org/news/{w}.html", 1) for k, w in enumerate(words[:60])]
    rows += [(300, "https://x.org/spam/unseen.html", None), (301, "https://x.org/news/unseen.html", None), (302, "https://x.org/spam/one/deeper", None),
             (303, "https://x.org/", None), (304, "https://other.org/spam/a.html", None)]
    # small bad branches beside small good ones: none has enough labels of its own
    rows += [(1000 + 10 * k + j, f"https://y.org/u/{w}/p{j}", int(k % 2)) for k, w in enumerate(words[:20]) for j in range(3)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == "block" for k in [*range(60), 300, 302])
    assert all(got[k] == "allow" for k in [*range(100, 160), 301, 303, 304])
    assert all(got[1000 + 10 * k + j] == ("allow" if k % 2 else "block") for k in range(20) for j in range(3))


def test_very_long_paths_repeated_rows_and_clashing_columns(spark):
    long = "https://x.org/" + "/".join(f"s{chr(97 + k % 26)}" for k in range(20_000))
    rows = [(1, long, 0)] * 7 + [(2, long + "x", 1), (3, "https://x.org/" + "a" * 200_000, None), (None, None, None), (None, "https://x.org/a", None)]
    names = ["host", "path", "raw", "parts", "above", "child", "below", "name", "n", "labelled", "bad", "node", "depth", "fit", "reject"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in names])
    got = url_filter.judge(df).collect()
    assert len(got) == len(rows)
    assert {r.verdict for r in got if r.page_id == 1} == {"block"}
    assert {(r.host, r.path, r.verdict) for r in got if r.page_id is None} == {("", "", "allow"), ("x.org", "/a", "block")}
