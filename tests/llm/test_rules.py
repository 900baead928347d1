"""Sharding, line rules and URL templates against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from evalspark.llm.line_quality import judge_lines, without_lines
from evalspark.llm.sharding import shard_records
from evalspark.llm.url_templates import Tree, filter_urls


def _draws(key, weights):
    seed = xxhash.xxh64_intdigest(("null" if key is None else str(key)).encode(), 42)
    found = []
    for shard, weight in enumerate(weights):
        bits = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed) >> 11
        found.append(weight / -math.log((bits + 0.5) / (1 << 53)) if weight else -1.0)
    return found.index(max(found))


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 3.0, 0.0, 0.5]])
def test_shards(spark, weights):
    rows = [(i, f"text {i % 7} é" * (i % 5), "x") for i in range(600)] + [(1, "again", "x"), (1, "again", "x"), (None, None, "x"), (None, "", "x"), (7, "long " * 50_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = shard_records(frame, weights).collect()
    expected = Counter()
    for key, text, _ in rows:
        data = (text or "").encode()
        expected[key, len(data) + 16, zlib.crc32(data), "key", _draws(key, weights), _draws(key, [*weights, 1.0])] += 1
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found) == expected
    assert all(r.grown_shard in (r.shard, len(weights)) for r in found)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert shard_records(frame.limit(0), weights).collect() == []


def test_wrong_weights(spark):
    for weights in ([], [0.0], [-1.0, 2.0], [math.inf]):
        with pytest.raises(ValueError):
            shard_records(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), weights)


WORD = re.compile("[^\x20\x09-\x0D]+")


def _lines(rows, least, share, kept_share):
    def norm(line):
        return " ".join(WORD.findall(line)).lower()

    sizes, documents = Counter(host or "" for _, _, host in rows), defaultdict(set)
    for i, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if WORD.search(line):
                documents[host or "", norm(line)].add(i)
    out = []
    for key, text, host in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        removed = sum(len(WORD.findall(line)) for line in lines if len(documents[host or "", norm(line)]) > max(least, share * sizes[host or ""]))
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((key, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and len(words) - removed >= kept_share * len(words), removed))
    return out


def test_line_rules(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]

    def say(k):
        return "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "  ", " # ", "%\n"]) for w in rng.choices(vocabulary, k=k))

    common = ["All  Rights reserved.", "share this\ton our site " * 6, "  Privacy Policy  "]
    rows = []
    for i in range(200):
        text = say(rng.randint(0, 120))
        if i % 2:
            text += "\n" + rng.choice(common) + "\n" + rng.choice(common).upper()
        rows.append((i, text, rng.choice(["a", "a", "b", None])))
    rows += [(300, None, "a"), (301, "", "a"), (302, "\x0b \x0c", "b"), (303, "x\u00a0y " * 60, "a"), (304, "a b c " * 40_000, "a"), (None, rows[1][1], "a"), (1, rows[1][1], rows[1][2]), (305, "only one line " * 30, None)]
    frame = spark.createDataFrame([(*row, "clash") for row in rows], "doc_id long, text string, source string, n_words string").repartition(3)
    for options in ((20, 0.01, 0.5), (3, 0.2, 0.9)):
        found = judge_lines(frame, least_documents=options[0], share=options[1], kept_share=options[2])
        got = [tuple(row) for row in found.drop("removed_lines").collect()]
        assert sorted(got, key=repr) == sorted(_lines(rows, *options), key=repr)
    assert judge_lines(frame.limit(0)).collect() == []


def test_lines_are_cut_out(spark):
    rows = [(i, f"own line {i}\nSame  line\nmore {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    found = judge_lines(docs).select(F.col("doc_id").alias("of"), "removed_lines")
    cut = docs.join(found, F.col("doc_id") == F.col("of")).select("doc_id", without_lines(F.col("text"), F.col("removed_lines")).alias("text"))
    assert sorted(map(tuple, cut.collect())) == [(i, f"own line {i}\nmore {i}") for i in range(30)]


ALLOW, BLOCK = ["com/", "www.example.com/en/"], ["example.com/en/", "net/es/", "net/fr/"]


def _parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fitting = [r for r in ALLOW + BLOCK if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fitting, key=len, default=None)


def _shape(path):
    out = []
    for segment in path.split("/"):
        if segment:
            ending = re.search(r"\.[A-Za-z]{1,5}$", segment)
            ending, body = (ending[0], segment[: ending.start()]) if ending else ("", segment)
            if re.fullmatch("[0-9]+", body):
                segment = "{n}" + ending
            elif re.fullmatch("[0-9a-fA-F-]{8,}", body) and re.search("[0-9]", body):
                segment = "{hex}" + ending
            elif re.search("[0-9]", body):
                segment = "{x}" + ending
            out.append(segment)
    return out


def _templates(rows, tree):
    """By (host, shape): template and whether it is rejected, grown as the operator describes it."""
    leaves = defaultdict(lambda: [0, 0, 0])
    for host, path, blocked in rows:
        leaf = leaves[host, tuple(_shape(path))]
        leaf[0] += 1
        if blocked is not None:
            leaf[1] += 1
            leaf[2] += blocked
    template = dict.fromkeys(leaves, "")
    for depth in range(tree.depth):
        groups = defaultdict(list)
        for leaf in leaves:
            groups[leaf[0], template[leaf]].append(leaf)
        grown = dict(template)
        for (_, above), members in groups.items():
            total, children = sum(leaves[m][0] for m in members), defaultdict(list)
            for m in members:
                if len(m[1]) > depth:
                    children[m[1][depth]].append(m)
            names, sums = {}, defaultdict(lambda: [0, 0])
            for child, own in children.items():
                named = sum(leaves[m][0] for m in own) * tree.named_children >= total or child.startswith("{")
                names[child] = child if named else "*"
                for m in own:
                    sums[names[child]][0] += leaves[m][1]
                    sums[names[child]][1] += leaves[m][2]
            ranked = []
            for name, (labelled, blocked) in sums.items():
                if labelled:
                    share = (blocked + 1.0) / (labelled + 2.0)
                    ranked.append((share, name, share * (1 - share) / (labelled + 2.0)))
            clusters = []
            for share, name, spread in sorted(ranked):
                if clusters and share - clusters[-1][-1][0] <= tree.same_z * math.sqrt(spread + clusters[-1][-1][1]):
                    clusters[-1].append((share, spread, name))
                else:
                    clusters.append([(share, spread, name)])
            joined = {name: "|".join(sorted(n for _, _, n in cluster)) for cluster in clusters for _, _, name in cluster}
            for child, own in children.items():
                for m in own:
                    grown[m] = above + "/" + joined.get(names[child], names[child])
        template = grown
    labelled, blocked = sum(v[1] for v in leaves.values()), sum(v[2] for v in leaves.values())
    prior, sums = (blocked + 1) / (labelled + 2), defaultdict(lambda: [0, 0])
    for leaf, (_, a, b) in leaves.items():
        sums[leaf[0], template[leaf]][0] += a
        sums[leaf[0], template[leaf]][1] += b
    rejected = {k: a >= tree.least_labels and (b + tree.prior * prior) / (a + tree.prior) >= tree.purity for k, (a, b) in sums.items()}
    return {leaf: (template[leaf], rejected[leaf[0], template[leaf]]) for leaf in leaves}


@pytest.mark.parametrize("tree", [Tree(), Tree(depth=2, named_children=3, same_z=2.0, least_labels=1)])
def test_urls(spark, tree):
    rng = random.Random(2)
    hosts = ["x.example.com", "www.example.com", "EXAMPLE.com", "a.net", "b.net", "c.org", "sub.b.net", "netting.org"]
    urls = []
    for i in range(600):
        parts = [rng.choice(["en", "es", "fr", "de", "EN"]), rng.choice(["", "blog", "shop", f"{rng.randint(1, 99)}", f"slug{i}", "tags"]), rng.choice([f"{i}.html", f"{i:08x}", "", "index.php", "a.b"])]
        urls.append(f"{rng.choice(['http', 'https', ''])}://{rng.choice(hosts)}/{'/'.join(parts)}{rng.choice(['', '?q=/x/', '#top', '/'])}")
    urls += [None, "", "no scheme/en/", "http://", "http://a.net", "http://a.net?x=/es/", "://b.net/es/", "http://a.net/es", "x://y://a.net/fr/", "http://É.net/fr/ü", "http://a.net/es/" + "x/" * 5000, urls[0]]
    rows = [(i, url, "x") for i, url in enumerate(urls)] + [(None, urls[1], "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = filter_urls(frame, ALLOW, BLOCK, rule=tree).collect()
    split = [_parts(url) for _, url, _ in rows]
    ruled = [(host, path, None if (r := _rule(host, path)) is None else r in BLOCK) for host, path in split]
    templates = _templates(ruled, tree)
    expected = []
    for (key, _, _), (host, path, blocked) in zip(rows, ruled):
        template, rejected = templates[host, tuple(_shape(path))]
        expected.append((key, host, path, _rule(host, path), "block" if (rejected if blocked is None else blocked) else "allow", template))
    assert sorted((tuple(row)[:6] for row in found), key=repr) == sorted(expected, key=repr)
    assert filter_urls(frame.limit(0), ALLOW, BLOCK).collect() == []


def _section(host, name, pages):
    return [f"http://{host}/{name}/{page}.html" for page in range(pages)]


def test_rare_sections_without_labels_do_not_share_the_labels_of_others(spark):
    sections = {"en": 400, "de": 400, "fr": 12, **{f"clean{c}": 12 for c in "abcdefghijklmno"}}
    urls = [url for name, pages in sections.items() for url in _section("a.net", name, pages)]
    # Of two rare labelled sections with different shares, each is judged by itself.
    urls += _section("b.net", "big", 2000) + _section("b.net", "es", 10) + _section("b.net", "fr", 10)
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = filter_urls(frame, ["b.net/fr/"], ["net/es/", "net/fr/"], rule=Tree(pool_labelled=False)).collect()
    blocked = Counter((r.host, r.path.split("/")[1]) for r in found if r.verdict == "block")
    assert len(found) == len(urls) and blocked == {("a.net", "fr"): 12, ("b.net", "es"): 10}
    templates = defaultdict(set)
    for r in found:
        templates[r.host, r.path.split("/")[1]].add(r.template)
    assert templates["a.net", "fr"] == {"/fr/{n}.html"} and templates["a.net", "cleana"] == {"/*/{n}.html"}
    assert templates["b.net", "es"] == {"/es/{n}.html"} and templates["b.net", "fr"] == {"/fr/{n}.html"}


def test_many_labelled_sections_of_equal_counts_make_one_branch(spark):
    urls = [url for i in range(300) for url in _section("a.net", "s" + "".join(chr(97 + int(d)) for d in f"{i:03}"), 2)]
    urls += _section("a.net", "open", 5)
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = filter_urls(frame, [], ["a.net/s"], rule=Tree(pool_labelled=False)).collect()
    assert Counter((r.template, r.verdict) for r in found) == {("/saaa|+299/{n}.html", "block"): 600, ("/*/{n}.html", "allow"): 5}
