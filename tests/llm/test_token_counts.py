"""Edit-aware counts: equal to encoding the edited text anew, with little encoded again."""

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm.encoder import encoder, tokenizer_path
from rankloom.llm.token_counts import FAN, TokenTree, apply_edits, in_order, redactions, token_trees

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXT = st.one_of(st.text(alphabet=" \n\tab'sé1. ,，日本", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "ab", ".", "'s"]), max_size=12).map("".join))


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=12), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 9), TEXT), max_size=6))
def test_edits_of_small_leaves_equal_encoding_anew(parts, edits):
    from rankloom.llm import token_counts

    before, token_counts.LEAF = token_counts.LEAF, 1
    try:
        for f in FILES:
            e = encoder(tokenizer_path(f))
            tree = TokenTree("".join(parts), e)
            assert tree.total == full(e, tree.text)
            for start, size, new in edits:
                a = min(start, len(tree.text))
                b = min(a + size, len(tree.text))
                want = tree.text[:a] + new + tree.text[b:]
                tree.edit(a, b, new)
                assert tree.text == want and tree.total == full(e, want)
    finally:
        token_counts.LEAF = before


def full(e, text):
    return len(e.tokenizer.encode(text, add_special_tokens=False).ids)


def check(node):
    """Sums of every node, and no run wider than it may be."""
    if node.below is None:
        assert node.chars == len(node.text)
        return
    assert 0 < len(node.below) <= 2 * FAN
    assert (node.chars, node.tokens) == (sum(x.chars for x in node.below), sum(x.tokens for x in node.below))
    for x in node.below:
        check(x)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=40), st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 60), TEXT), max_size=6))
def test_edits_equal_encoding_anew(parts, edits):
    text = " ".join(parts)
    for f in FILES:
        e = encoder(tokenizer_path(f))
        tree = TokenTree(text, e)
        assert tree.total == full(e, text)
        for start, size, new in edits:
            a = min(start, len(tree.text))
            b = min(a + size, len(tree.text))
            want = tree.text[:a] + new + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.total == full(e, want)
            check(tree.root)
            assert sum(n for n, _ in tree.leaves()) == len(want)


def test_only_touched_regions_are_encoded():
    e = encoder(tokenizer_path(FILES[0]))
    tree = TokenTree("some plain words " * 20_000, e)
    tree.encoded = 0
    tree.edit(100_000, 100_010, "other")
    assert tree.encoded < 1000 and tree.total == full(e, tree.text)


def test_texts_without_spaces_are_cut_too():
    e = encoder(tokenizer_path(FILES[0]))
    for text in ("日本語の文章は、空白なしで続く。" * 2500, "one\n" * 10_000, "a,b;c(d)" * 5000, "x=1\n\ty=2\n" * 4000):
        tree = TokenTree(text, e)
        assert tree.total == full(e, text) and len(tree.leaves()) > len(text) / 300
        tree.encoded = 0
        tree.edit(20_000, 20_003, "本x")
        assert tree.encoded < 1000 and tree.total == full(e, tree.text)


def test_an_edit_makes_and_breaks_added_tokens_across_cuts(monkeypatch):
    from rankloom.llm import token_counts

    monkeypatch.setattr(token_counts, "LEAF", 2)
    e = encoder(tokenizer_path(FILES[0]))
    tree = TokenTree("ab cd  <|endoftext|> ef.gh <|endof text|>\nxy", e)
    for a, b, new in ((7, 8, ""), (7, 7, "<"), (35, 36, ""), (4, 5, "<|endoftext|>"), (3, 5, "  "), (0, 1, "<|"), (2, 30, "endoftext|>")):
        want = tree.text[:a] + new + tree.text[b:]
        tree.edit(a, b, new)
        assert tree.text == want and tree.total == full(e, want)


def test_many_edits_of_a_long_text_cost_their_paths():
    import time

    e = encoder(tokenizer_path(FILES[0]))
    text = "some plain words and 123456789 numbers " * 60_000
    tree = TokenTree(text, e)
    tree.encoded = 0
    at = [i for i in range(len(text) - 20, 0, -400)]
    begin = time.perf_counter()
    for i in at:
        tree.edit(i, i + 9, "[removed]")
    assert time.perf_counter() - begin < 30 and tree.encoded < 1200 * len(at)
    check(tree.root)
    assert tree.total == full(e, tree.text)


def test_order_of_edits():
    edits = [{"start": 5, "end": 9, "text": "b"}, None, {"start": 0, "end": 6, "text": "a"}, {"start": 90, "end": 99, "text": None}, {"start": None, "end": 1, "text": "x"}]
    assert in_order(edits, 10) == [(0, 6, "a"), (10, 10, "")]
    assert in_order(None, 5) == []


def test_query(spark):
    path = tokenizer_path(FILES[0])
    rows = [(1, None), (2, ""), (3, "mail me at a.b@c.org or 4370598173842409 now " * 300), (3, "again"), (None, "token = 608866bb6ce402061353d365de9418d6b055c734"), (4, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'e' AS edits", "1 AS id").repartition(2)
    got = apply_edits(token_trees(redactions(docs), path, edits_col="edits"), path).collect()
    e = encoder(path)
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == full(e, r.text) and "@" not in r.text and "4370" not in r.text and "6088" not in r.text
    assert {r.n_edits for r in got if r.id == 3} == {600, 0}
    assert apply_edits(token_trees(redactions(docs.limit(0)), path, edits_col="edits"), path).count() == 0
