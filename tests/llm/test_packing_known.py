"""A piece goes to the library once for all chunks of a worker, and its ids are the library's."""

from latticework.llm import packing

TEXTS = [
    "plain words, plain words; ends... with marks!? (brackets) [and] it's they'll ' 's 'tis don't'", "größer, élan! naïve? straße. ñandú--", "a1 b2, 3.14 x_y _z_ __ #tag @at a@b.c",
    "words' end'' ''' l'été, 中文, 中文。 ไทย! ١٢, Ⅷ. ª! ²! é, ́! ", "", " ", "tab\tline\nnext wide　gap ​, x​,", "plain words, again and again",
]


def test_known_pieces_are_not_encoded_again(monkeypatch):
    coder, sent = packing.WordBPE(packing.TOKENIZER), []
    pieces = coder._pieces
    monkeypatch.setattr(coder, "_pieces", lambda x: sent.extend(x) or pieces(x))
    first, again = (list(map(list, coder.ids(["plain words, and more", "words again!"]))) for _ in range(2))
    assert first == again
    assert len(sent) == len(set(sent)) and {"plain", "words", ",", "!"} <= set(sent)


def test_ids_are_the_librarys_when_known_or_forgotten(monkeypatch):
    coder = packing.WordBPE(packing.TOKENIZER)
    want = [coder.lib.encode(t, add_special_tokens=False).ids for t in TEXTS]
    monkeypatch.setattr(packing, "CHUNK", 1)  # a chunk a text
    for known in (1 << 25, 600, 0):
        monkeypatch.setattr(packing, "KNOWN", known, raising=False)
        for some in (TEXTS, TEXTS[::-1], TEXTS):
            got = [list(x) for x in coder.ids(some)]
            assert got == (want if some is TEXTS else want[::-1])
