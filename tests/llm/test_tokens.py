import random

import pytest
from tokenizers import Tokenizer

from tracebed.llm.tokens import PrefixEncoder, appended_ids, default_vocabulary, encode_texts, update_texts
from tracebed.session import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "\n\n  \t", "Hello, world! It's 12:30 <|endoftext|>", "naïve café – 漢字 🚀👩‍💻 ﷽", "a" * 5000, " " * 700 + "x", "=-" * 900, "don't we'll I'VE they're'", "\x00\x01 é́",
    "def f(x):\n    return x_1 + 0x1F  # TODO\r\n",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(default_vocabulary(), "rb") as f:
        return PrefixEncoder(f.read())


def test_equals_the_public_tokenizer(encoder, reference):
    rng = random.Random(2)
    noise = ["".join(rng.choice("ab'é \n1_漢🚀-=") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in TEXTS + noise:
        assert encoder.encode(text) == reference(text), repr(text)[:80]


def test_prefixes_hold_the_encoding_of_each_prefix(encoder):
    piece = b" internationalisation"
    lasts = encoder.prefixes(piece)
    for i in range(1, len(piece) + 1):
        assert encoder.ids_of(lasts[:i]) == encoder.merged(piece[:i])


def test_appends_and_edits_equal_encoding_anew(encoder):
    rng = random.Random(8)
    for _ in range(300):
        old = "".join(rng.choice(["it", "'", "re", " ", "  ", "scan", "12", "é", "🚀", "\n", "."]) for _ in range(rng.randint(0, 25)))
        a = rng.randint(0, len(old))
        new = rng.choice([old + rng.choice(["'re", " x", "\n", "scan"]), old[:a] + rng.choice(["", "z", " q "]) + old[a + rng.randint(0, 5) :]])
        table, ids = encoder.updated(old, encoder.table(old), new)
        assert ids == encoder.encode(new) and table == encoder.table(new)


def test_tables(spark, reference):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(0, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = encode_texts(docs).collect()
    assert len(got) == len(rows) and all(list(r.ids) == reference(TEXTS[r.doc_id]) for r in got)
    assert dict(encode_texts(docs).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    assert encode_texts(docs.limit(0)).count() == 0


def test_update_of_stored_tables(spark, reference):
    docs = spark.createDataFrame([(1, "it'"), (2, None), (3, "abc def")], "doc_id bigint, text string")
    stored = docs.join(encode_texts(docs, with_prefixes=True), "doc_id")
    changed = {1: "it're done", 2: "now", 3: "abc dxf", 4: "new one"}
    got = update_texts(stored, spark.createDataFrame(list(changed.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {k: reference(v) for k, v in changed.items()}
    assert all(len(r.prefix_tokens) == len(changed[r.doc_id].encode()) for r in got)


def test_appended_texts_go_on_from_stored_prefixes(spark, reference):
    rows = [(i, t, r) for i, (t, r) in enumerate([(None, None), ("", "a"), ("it'", None), ("x  ", "core-api"), ("naïve 漢字", "é")])]
    docs = spark.createDataFrame(rows + rows[-1:] + [(None, "x", "y")], "doc_id bigint, text string, repo string")
    got = appended_ids(docs, Scratch(spark, "t")).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: reference(f"{t or ''}\n{r or ''}") for i, t, r in rows} and len(got) == len(rows)
    assert appended_ids(docs.limit(0), Scratch(spark, "t")).count() == 0


def test_no_token_is_missed_behind_a_long_stored_prefix(encoder):
    word = "a" * 3 + "=" * (encoder.longest + 7)
    for cut in (1, encoder.longest - 1, encoder.longest, len(word) - 1):
        table, ids = encoder.updated(word[:cut], encoder.table(word[:cut]), word)
        assert ids == encoder.encode(word) and table == encoder.table(word)
