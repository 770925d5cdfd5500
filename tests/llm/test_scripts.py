"""Languages whose scripts share no letters with the others, small and large."""

import numpy as np

from tessera.llm import lang_id


def _words(first, last, seed, n=3000):
    rng = np.random.default_rng(seed)
    letters = [c for c in map(chr, range(first, last)) if c.isalpha() and c == c.lower()]
    words = ["".join(rng.choice(letters, rng.integers(2, 6))) for _ in range(300)]
    return [" ".join(rng.choice(words, 40)) for _ in range(n // 40)]


def test_many_scripts():
    ranges = {"latin": (0x61, 0x7B), "cyrillic": (0x430, 0x450), "greek": (0x3B1, 0x3CA), "hebrew": (0x5D0, 0x5EB), "arabic": (0x621, 0x64B), "thai": (0xE01, 0xE2F), "han": (0x4E00, 0x5400), "hangul": (0xAC00, 0xB200)}
    texts = {k: _words(*r, seed) for seed, (k, r) in enumerate(ranges.items())}
    # Two languages of one small and of one large script, told apart by their words only.
    texts |= {"greek2": _words(0x3B1, 0x3CA, 100), "han2": _words(0x4E00, 0x5400, 101)}
    model = lang_id.Model({k: "\n".join(v[:-5]) for k, v in texts.items()})
    for k, v in texts.items():
        assert [lang for lang, *_ in model.predict(v[-5:])] == [k] * 5
