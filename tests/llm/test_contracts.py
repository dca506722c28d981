"""Cases of the contracts that the tables at hand don't hold, and large groups."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from quillon.llm import common, decontaminate, extract, langid, linededup, links, media, neardup, secrets
from test_links import brute, line_brute, near_texts


def test_comments_in_nested_articles_go():
    assert extract.extract("<article><p>Body text.</p><article class='comment'><p>Nice one</p></article></article>") == "Body text."
    assert extract.extract("<main><p>Body text.</p><section><article id='comment-12'><p>Nice one</p></article></section></main>") == "Body text."
    assert extract.extract("<article class='post widget'><p>Body text.</p></article>") == "Body text."


def test_a_quote_that_stays_open_is_no_text():
    assert extract.extract('<p>One <a href="x>link</a> two</p>') == "One link two"
    assert extract.extract("<p>One <a title='a > b' href=x>link</a> two</p>") == "One link two"


def test_an_articles_own_heading_stays():
    assert extract.extract("<div class='article-header'><h1>Title</h1></div><p>Body text, which is long.</p>") == "Title\n\nBody text, which is long."
    assert extract.extract("<div class='site-header'><h1>Title</h1></div><p>Body text, which is long.</p>") == "Body text, which is long."


def test_deep_pages_take_linear_time():
    def took(n):
        began = time.process_time()
        assert extract.extract("<div>" * n + "<p>Text</p>" * 50 + "</p></b>" * n).startswith("Text")
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 30 * max(took(4000), 0.02)


def test_letters():
    assert langid.words("½ ² Ⅷ 12 _") == []
    assert langid.words("हिन्दी été") == ["हिन्दी", "été"]
    assert langid.words("a1b½c") == ["a", "b", "c"]


def test_tokens_against_all_spans():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["token=", "abcdef0123456789abcdef0123", " ", "AKIA", "ABCDEFGH12345678", "xyz.", "-", "password: "]) for _ in range(rng.randrange(1, 30)))
        base = secrets.base_spans(text)
        whole = [(m.start(), m.end(), m[0]) for m in secrets.TOKEN.finditer(text) if m.end() - m.start() >= 6]
        assert list(secrets.tokens(text, base, 6)) == [(a, b, w) for a, b, w in whole if not any(x <= a and b <= y for x, y, *_ in base)]
        assert list(secrets.ordinary(text, base)) == [w for a, b, w in whole if len(w) >= secrets.LEAST and not any(x < b and a < y for x, y, *_ in base)]


def test_blocks_are_passed_over_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 4)
    rng = random.Random(8)
    common_words = [f"c{k}" for k in range(30)]
    items = [(i, " ".join(rng.sample(common_words, 12) + [f"rare{i}"] * (i % 3))) for i in range(300)]
    index = decontaminate.build(items)
    counts = Counter()
    for _ in range(200):
        text = rng.sample(common_words, rng.randrange(5, 30)) + [f"rare{rng.randrange(300)}"]
        terms = {index.term[w] for w in text if w in index.term}
        want = [(n, s) for n, w in enumerate(index.weights) if (s := sum(x for t, x in w.items() if t in terms)) >= decontaminate.THRESHOLD - 1e-9]
        assert index.search(np.array(sorted(terms)), counts) == want
    assert counts["passed over"] > 0 and counts["scored"] < 200 * 300 / 2


def test_all_forms_of_media_are_in_use_and_read_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc \n") for _ in range(rng.randrange(0, 9000))) for _ in range(60)] + [None, "", "é" * 70_000]
    forms = {media.form_of(media.payload_of(t)[0]) for t in texts}
    assert {f[0] for f in forms} == set(media.COMPRESSIONS) and {f[1] for f in forms} == {1, 2} and len({f[2] for f in forms}) == 2
    files = media.files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).repartition(3)
    rows = {}
    for r in media.pages(files, "media").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        found = sorted(rows[k], key=lambda r: r["page"])
        payload, n = media.payload_of(t)
        assert b"".join(r["samples"] for r in found) == payload and found[0]["n_bytes"] == n and [r["page"] for r in found] == list(range(len(found)))
    digests = media.pages(files, "media").mapInArrow(media._digests, media.DIGEST_SQL).collect()
    assert {r["doc_id"]: r["payload_sha256"] for r in digests} == {k: hashlib.sha256(media.payload_of(t)[0]).hexdigest() for k, t in enumerate(texts)}


def test_a_null_id_and_a_null_text_are_told_apart(spark):
    docs = spark.createDataFrame([(5, None), (None, "5")], "doc_id long, text string")
    assert docs.select(neardup.doc_key().alias("k")).distinct().count() == 2
    kept = neardup.keep_one(spark, spark.createDataFrame([(5, None), (None, "5"), (6, "5")], "doc_id long, text string"), "")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "6"]


@pytest.mark.parametrize("task", [2, 8192])
def test_groups_that_fall_apart_again_and_again(spark, monkeypatch, task):
    monkeypatch.setattr(links, "TASK", task)
    monkeypatch.setattr(links, "FEW", 2)
    monkeypatch.setattr(links, "FEW_RARE", 2)
    texts = near_texts(5, 80)
    rows, _ = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()} == brute(texts, range(len(texts)))


def test_a_large_group_costs_comparisons_in_proportion(spark, monkeypatch):
    """3000 near copies of one text, and 1000 texts that share a long passage."""
    seen = []
    real = links.verified

    def counting(pairs, *a):
        seen.append(pairs.count())
        return real(pairs, *a)

    monkeypatch.setattr(links, "verified", counting)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(3000):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(1000)]
    rows, _ = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = [r["component_id"] for r in sorted(rows.collect(), key=lambda r: r["doc_id"])]
    assert set(got[:3000]) == {0} and got[3000:] == list(range(3000, 4000))
    assert sum(seen) < 20 * len(texts)


def test_line_keys_that_many_lines_share(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GATHER_LINES", 7)
    monkeypatch.setattr(linededup, "PARTS", 3)
    rng = random.Random(6)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    base = line(12).split()
    texts = ["\n".join(" ".join([*base[:-1], rng.choice([base[-1], line(1)])]) if rng.random() < 0.6 else line(8) for _ in range(5)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = linededup.banded(docs, 200).collect()
    keys = {}
    for x in {linededup.normal(x) for t in texts for x in t.split("\n")}:
        for k in linededup.line_keys([x])[0].tolist():
            keys.setdefault(k, set()).add(linededup.node_of(x))
    want = {frozenset(v) for v in keys.values() if len(v) > 1}
    got = {}
    for r in found:
        got.setdefault(r["bucket"], set()).add(r["node"])
    assert {frozenset(v) for v in got.values()} == want and all(len(got[r["bucket"]]) == r["n"] for r in found)
    dropped, _ = linededup.with_dropped(docs)
    by = {r["k"]: r["doc_id"] for r in docs.select("doc_id", neardup.doc_key().alias("k")).collect()}
    assert {by[r["doc_key"]]: set(r["lines"]) for r in dropped.collect()} == line_brute(texts)


def test_kept_tables_go(spark):
    df = common.keep(spark.range(3), "t")
    path = df._kept_at
    assert path in common._written
    common.discard(df, spark.range(2))
    assert path not in common._written
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_a_model_is_fitted_on_an_executor(spark):
    rows = spark.createDataFrame([("b", 2, "y", 0), ("a", 3, "x", 1), ("a", 1, "z", 1)], "draw string, doc_id long, text string, label int")
    assert common.fitted(rows, lambda found: list(found)) == [("z", 1), ("x", 1), ("y", 0)]
    assert common.fitted(rows.where("label > 5"), lambda found: list(found)) == []


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline
    from quillon.llm import mixing, quality

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    assert len(docs) == table.count()
    learned = quality.train(table, spark.read.parquet(f"{sf}/labels.parquet"))
    score = quality.scorer(learned)
    docs = {i: x for i, x in docs.items() if score(x[0]) >= quality.THRESHOLD}
    ids = sorted(docs)
    gone = {ids[k]: lines for k, lines in line_brute([docs[i][0] for i in ids]).items()}
    for i, lines in gone.items():
        text = "\n".join(x for k, x in enumerate(docs[i][0].split("\n")) if k not in lines)
        docs[i] = (text, docs[i][1])
        if not re.search(r"\S", text):
            del docs[i]
    ids = sorted(docs)
    least = brute([docs[i][0] for i in ids], ids)
    docs = {i: docs[i] for i in ids if least[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.build(items)
    searcher = decontaminate.Searcher(index)

    def leaks(text):
        found = decontaminate.words(text)
        passages = [{index.term[w] for w in found[k * index.stride : (k + 2) * index.stride] if w in index.term} for k in range(max(1, -(-len(found) // index.stride) - 1))]
        return any(sum(w for t, w in index.weights[n].items() if t in p) >= decontaminate.THRESHOLD - 1e-9 and searcher.verify(found, n)[2] for p in passages for n in range(len(index.items)))

    docs = {i: x for i, x in docs.items() if not leaks(x[0])}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", x[0] or "")) for i, x in docs.items()}
    sources = sorted({x[1] for x in docs.values()})
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, x in docs.items() if x[1] == s) for s in sources}
    target, free, budget = {}, set(sources), sum(total.values())
    while True:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * total[s] for s in over}
        free -= over
    draw = lambda i: hashlib.md5(f"mix{i}".encode()).hexdigest()
    queue = []
    for k, s in enumerate(sources):
        dealt = 0
        for e in range(3):
            for d, i in sorted((draw(i), i) for i, x in docs.items() if x[1] == s):
                dealt += size[i]
                queue.append((dealt / target[s] if target[s] else 0.0, k, d, str(i), i))
    taken, used = Counter(), 0
    for *_, i in sorted(queue):
        used += size[i]
        if used > budget:
            break
        taken[i] += 1
    got = {r["doc_id"]: (r["text"], r["copies"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: (docs[i][0], n) for i, n in taken.items()}


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, quality_score int, line_key string"
    odd = [(None, None, None, None, None, "c", 1, "k"), (1, "", None, "s", 0, None, None, None), (4, "Only one line.", "en", "s", 14, "c", 1, "k"), (4, "Only one line.", "en", "s", 14, "c", 1, "k"), (5, "1234 !!", "en", None, 7, "c", 1, "k")]
    for at, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{at}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/{at}/benchmark.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{at}")
        assert out.columns == [*schema.replace(" string", "").replace(" long", "").replace(" int", "").split(", "), "copies_"]
        assert [r["doc_id"] for r in out.where("text = 'Only one line.'").collect()] == [4] * bool(rows)


def test_recall_of_planted_lines(spark):
    """Thousands of pairs of lines at the threshold, found end to end."""
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    line = lambda n: "".join(letters[rng.integers(0, 26, n)])
    lines, pairs = [], 0
    while pairs < 2000:
        shared, tail = line(180), int(rng.integers(20, 31))
        left, right = shared + line(tail), shared + line(tail)
        x, y = linededup._set(left), linededup._set(right)
        both = len(np.intersect1d(x, y))
        if 75 <= 100 * both / (len(x) + len(y) - both) < 77:
            lines += [left, right]
            pairs += 1
    dropped, _ = linededup.with_dropped(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert dropped.count() >= 0.998 * pairs
