"""What op4's workers remember of words."""

from creasework.llm import packing


def test_frequent_words_stay_remembered():
    """Before, full memory was emptied, and the tokenizer was asked again for each word; rare words with signs took two
    places in it."""
    tokens = packing.WordTokens(packing.default_tokenizer())
    tokens.MEMORY, asked, piece = 40_000, [], tokens._piece
    tokens._piece = lambda p: asked.append(p) or piece(p)
    letters = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    texts = [f"Often seen, it's {letters(i)}x. {letters(i)}Y! often naïve {letters(i)}x." for i in range(1000)]
    got = [tokens.ids(t) for t in texts]
    assert all(asked.count(p) == 1 for p in ("often", "seen", ",", "'s", "naïve"))
    assert tokens.bytes + sum(200 + len(v) for v in tokens.older.values()) < 2 * tokens.MEMORY
    encode = packing.WordTokens(packing.default_tokenizer()).tokenizer.encode
    for text, ids in zip(texts[::50], got[::50], strict=True):
        assert list(memoryview(ids).cast("I")) == encode(text, add_special_tokens=False).ids
