"""The other operators: held-out accuracy, brute force, round trips, odd tables."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillon.llm import decontaminate, extract, langid, media, quality, queries, secrets, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "   \n\t ", "en", None, 6), (3, "x" * 200_000, "en", "s", 200_000), (4, "Only one line.", "en", "s", 14), (4, "Only one line.", "en", "s", 14), (5, "1234 !!", "en", "s", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, found string, label string"


@pytest.fixture
def odd_dir(spark, tmp_path):
    docs = spark.createDataFrame([(*r, 0.5, "f", "l") for r in ODD], SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(4, 1, 0), (1, None, None), (None, 1, 1), (3, 0, 1), (3, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "x y"), (2, "!!"), (3, "Only one line.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "u", None), (None, None, "<p>a"), (2, "v", "")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return str(tmp_path)


@pytest.fixture
def empty_dir(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", [n for n in queries.queries()])
def test_odd_and_empty_tables(spark, odd_dir, empty_dir_factory, name):
    n = 3 if name == "op7_html" else 2 if name == "op9_decontamination" else len(ODD)
    assert queries.queries()[name](spark, odd_dir).count() == n
    assert queries.queries()[name](spark, empty_dir_factory).count() == 0


@pytest.fixture
def empty_dir_factory(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string")):
        spark.createDataFrame([], schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def accuracy(spark, name, label):
    got = queries.queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    return (got["predicted"] == got[label]).mean()


def test_quality_of_held_out_documents(spark):
    assert accuracy(spark, "op1_quality", "quality") > 0.95


def test_toxicity_of_held_out_documents(spark):
    assert accuracy(spark, "op2_toxicity", "toxic") > 0.92


def test_quality_model_folds_without_loss():
    model = quality.fit([("good words here", 1), ("BAD!! BAD!!", 0)] * 20)
    score = quality.scorer(model)
    words = "good BAD!! x x".split()
    logit = model["bias"] + (sum(float(model["add"][quality.features(w)].mean()) for w in words) + float(model["add"][quality._REPEAT])) / len(words)
    assert abs(score("good BAD!! x x") - 1 / (1 + math.exp(-logit))) < 1e-6
    assert score("good words here") > 0.7 > 0.3 > score("BAD!! BAD!!")
    assert score(None) == score("") == score(" ")


def test_offending_sentences_are_located(spark):
    rows = [("it is fine here. all is well today.", 0), ("we like the lake. a calm walk.", 0)] * 30 + [("it is fine here. you moron go away. all is well.", 1)] * 20
    weights = toxicity.fit(rows)
    text = "we like the lake. you moron go. fine."
    found = toxicity.with_score(spark.createDataFrame([(text,), (None,)], "text string"), weights, "f").select("f.*").collect()
    spans = [s for r in found for s in r["offending"]]
    assert [text[s["start"] : s["end"]].strip() for s in spans] == ["you moron go"]
    assert sorted(r["score"] for r in found)[0] == 0


def base_brute(text):
    found = []
    for k, (kind, (pattern, group, least)) in enumerate(secrets.BASE.items()):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(2)
    parts = ["password=", "api_key: '", "TOKEN =", "AKIA", "A" * 16, "AKIA" + "B7" * 9, "0123456789abcdef" * 2, "abc", " ", "ſecret=abcdefg", "secret:secret=abcdef12", "é", "x" * 5, "=", "\n"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [(a, b, kind) for a, b, kind, _ in secrets.base_spans(text)] == base_brute(text)


def test_secrets_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op3_secrets"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        spans = base_brute(r["text"] or "")
        joined = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [g["n_assign"], g["n_access"], g["n_hex"]] == [sum(s[2] == k for s in spans) for k in secrets.BASE]
        assert set(joined.split(",")) - {""} <= set(g["spans"].split(","))


def test_automata_tell_formats_apart():
    rng = random.Random(3)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    keys = ["AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(200)]
    plain = [draw("aeinorst", rng.randrange(16, 24)) for _ in range(200)] + [draw("0123456789", 16) for _ in range(60)]
    model = secrets.Model({"access": secrets.infer(keys)}, secrets.infer(plain))
    assert len(model.formats["access"].next) < 30
    assert model.is_secret("AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16))
    assert not any(map(model.is_secret, plain))
    total = sum(math.exp(secrets.infer(["a", "ab", "ab"]).likelihood(s)) for n in range(4) for s in map("".join, itertools.product("ab", repeat=n)))
    assert total < 1.01
    assert secrets.infer([]) is None


@pytest.mark.parametrize("compression", [media.RAW, media.LZW, media.DEFLATE, media.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("shape", [{}, {"strip_rows": 7}, {"tile": 16}])
def test_tiff_round_trip(compression, predictor, shape):
    rng = np.random.default_rng(0)
    pages = [rng.integers(0, 256, (50, 64)).astype(np.uint8), np.zeros((200, 64), np.uint8), np.frombuffer((b"the quick brown fox " * 2000)[: 64 * 400], np.uint8).reshape(-1, 64)]
    got = media.read_tiff(media.write_tiff(pages, compression, predictor, **shape))
    assert len(got) == 3 and all((a == b.samples[:, :, 0]).all() for a, b in zip(pages, got))


def test_big_endian_and_sixteen_bits():
    import struct

    samples = np.array([[1, 2, 300, 40], [5, 6, 7, 65535]], ">u2")
    diff = samples.astype(np.uint16)
    diff = np.diff(diff, axis=1, prepend=np.zeros((2, 1), np.uint16)).astype(">u2").tobytes()
    fields = [(256, 3, 4), (257, 3, 2), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(diff)), (317, 3, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields)
    data = b"MM\0*" + struct.pack(">I", 8 + len(diff)) + diff + struct.pack(">H", len(fields)) + entries + b"\0\0\0\0"
    page = media.read_tiff(data)[0]
    assert (page.samples[:, :, 0] == samples).all() and page.bits == 16


def test_pages_of_good_and_bad_files(spark):
    good = media.write_tiff([np.arange(128, dtype=np.uint8).reshape(2, 64)] * 2)
    rows = [(1, bytearray(good)), (2, bytearray(good[:40])), (3, None), (4, bytearray(b"nothing"))]
    got = media.pages(spark.createDataFrame(rows, "id long, file binary"), "file").collect()
    assert sorted((r["id"], r["page"]) for r in got if not r["error"]) == [(1, 0), (1, 1)]
    assert sorted(r["id"] for r in got if r["error"]) == [2, 4]
    assert all(bytes(r["samples"]) == bytes(range(128)) for r in got if not r["error"])


def test_media_query(spark):
    got = {r["doc_id"]: r for r in queries.queries()["op8_tiff"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_html_query(spark):
    for r in queries.queries()["op7_html"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.sub(r"</?(?:h1|p)>", "\0", re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1])
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]*>", " ", article).split("\0"))
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("page, text", [
    ("<body><div id=header>Top, menu</div><div class='content'><p>Hello, world &amp;amp; more</p><p>Second<br>line</p><ul><li>one<li>two</ul></div><div class='comments'><p>Nice, very nice</p></div></body>", "Hello, world &amp; more\n\nSecond line\n\none\n\ntwo"),
    ("<article><h1>T</h1><table><tr><td>a<td>b<tr><td>c</table><form><p>Ask</p></form>tail <a href=x>link</a> end</article>", "T\n\na\n\nb\n\nc\n\ntail link end"),
    ("<p>a<script>var x='<p>'</script>b</p>", "ab"),
    ("<nav><a href=a>one</a><a href=b>two</a></nav>", ""),
    ("plain &lt;text&gt;, only", "plain <text>, only"),
    ("<main><div><p>" + "Long text, with commas, " * 9 + "</p></div><aside>Side</aside><section><p>End.</p></section></main>", ("Long text, with commas, " * 9).strip() + "\n\nEnd."),
    ("<div>1 < 2 and <!-- gone --> 3</div><!-- open", "1 < 2 and 3"),
    (None, ""), ("", ""), ("<", "<"), ("<p", ""),
])
def test_extracted_text(page, text):
    assert extract.extract(page) == text


def test_forward_sums_all_segmentations():
    ids = {v: i for i, v in enumerate([langid.START, langid.START + "a", "a", "b", "ab", "ba", "aab"])}
    rng = np.random.default_rng(0)
    model = langid.Model(["x", "y"], ids, np.vstack([rng.random((len(ids), 2)), [[1e-7, 1e-7]]]))
    for word in ("a", "ab", "aabab", "cab", "ß", "abaabaab" * 5):
        marked = langid.START + word
        if len(word) < 12:
            want = np.zeros(2)
            for cut in itertools.product((0, 1), repeat=len(marked) - 1):
                at = [0, *(i for i, c in enumerate(cut, 1) if c), len(marked)]
                parts = [marked[a:b] for a, b in itertools.pairwise(at)]
                rows = [ids.get(p, len(ids) if len(p) == 1 else None) for p in parts]
                if None not in rows:
                    want += np.prod(model.p[rows], axis=0)
        else:
            want = np.exp(langid._long_word(marked, model, model.widest))
        assert np.allclose(langid.log_likelihoods([word], model, langid.Pieces(ids))[0], np.log(want))


def test_language_of_held_out_documents(spark):
    got = queries.queries()["op10_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97


def test_search_retrieves_all_above_the_threshold():
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 40)))) for i in range(60)]
    index = decontaminate.build(items)
    searcher = decontaminate.Searcher(index)
    for _ in range(60):
        found = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        if rng.random() < 0.7 and found:
            at = rng.randrange(len(found))
            found[at:at] = decontaminate.words(rng.choice(items)[1])
        best, n = searcher.retrieve(found)
        passages = [set(found[k * index.stride : (k + 2) * index.stride]) for k in range(n)]
        want = {}
        for i in range(len(index.items)):
            scores = [sum(w for t, w in index.weights[i].items() if t in {index.term[x] for x in p if x in index.term}) for p in passages]
            if scores and max(scores) >= decontaminate.THRESHOLD - 1e-9:
                want[i] = max(scores)
        assert best.keys() == want.keys() and all(abs(best[i] - want[i]) < 1e-9 for i in want)


def test_contaminated_documents(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op9_decontamination"](spark, SF).collect()}
    norm = lambda t: f" {' '.join(decontaminate.words(t))} "
    items = [(r["item_id"], norm(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], norm(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got >= {(d, i) for d, t in docs for i, x in items if x in t}
    assert len(got) < 1.2 * len({(d, i) for d, t in docs for i, x in items if x in t}) + 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "mixing"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert 0 < out.count() < docs.count()
