"""Short tokens, and tokens that hold a fixed match, are scored."""

import random
from collections import defaultdict

from quillon.llm import secrets


def test_short_bare_credential(spark):
    rng = random.Random(5)
    draw = lambda: "Z" + "".join(rng.choice("QXJKVW0123456789") for _ in range(9))
    word = lambda: "".join(rng.choice("aeinorstlm") for _ in range(rng.randrange(6, 14)))
    rows = [(k, f"{word()} {word()} password={draw()} {word()}") for k in range(300)]
    model = secrets.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model.least == 10
    bare, ordinary = draw(), word()
    secret = {x: model.is_secret(x) for x in (bare, ordinary)}
    assert secret == {bare: True, ordinary: False}
    found = secrets.all_spans(f"see {bare} now", defaultdict(bool, secret))
    assert found == [{"kind": "learned", "start": 4, "end": 14}]


def test_token_around_a_fixed_match():
    token = "Key-" + "0123456789abcdef" * 2 + "-Zz9"
    found = secrets.all_spans(f"a {token} b", {token: True})
    assert {(x["kind"], x["start"], x["end"]) for x in found} == {("hex", 6, 38), ("learned", 2, 2 + len(token))}
