import random

import pyarrow as pa

from episight.llm.common import Words, hash_words


def test_numbers_stand_for_the_words_of_any_slice():
    rng = random.Random(1)
    for _ in range(100):
        words, texts = Words(), ["".join(rng.choice("aAbÉ \t\n\x0b\x1cx") for _ in range(rng.randint(0, 12))) for _ in range(7)]
        whole = pa.array(texts)
        for s, n in ((0, 3), (3, 4)):
            flat, size, _ = words.read(whole.slice(s, n))
            known = words.all.to_pylist()
            assert [known[i] for i in flat] == [x for t in texts[s : s + n] for x in [*t.encode().lower().split(), b""]]
            assert size.tolist() == [len(t.encode().lower().split()) + 1 for t in texts[s : s + n]]
        assert len(set(known)) == len(known) == len(set(words.hash.tolist())) and (words.hash == hash_words(words.all)).all()


def test_no_texts():
    flat, size, new = Words().read(pa.array([], pa.string()))
    assert len(flat) == len(size) == len(new) == 0
