import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from listinglake.llm.divergence import cell_distances, divergence, terms
from tests.conftest import rows

SHAPE = "doc_id long, text string, lang string, source string, n long, term string, value string, rank int, total long, v long, no int, p long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(docs, least, top):
    """docs: (text, lang, source); every group, term and pair written out."""
    docs = [tuple(x or "" for x in d) for d in docs]
    found, out = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(AZ)), lang, s) for t, lang, s in docs], []
    for lang in {d[1] for d in docs}:
        seen = Counter(w for words, at, _ in found if at == lang for w in set(words))
        kept = [w for w, n in seen.items() if n >= least]
        counts = defaultdict(Counter)
        for words, at, source in found:
            if at == lang:
                counts[source].update(w for w in words if w in set(kept))
        v = len(kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        shares, whole = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s, p in shares.items():
            pairs = [(o, sum(far(p[w], q[w]) for w in kept)) for o, q in shares.items() if o != s]
            over = [(w, far(p[w], whole[w])) for w in kept if counts[s][w] and p[w] > whole[w]]
            for part, items, most in (("pair", pairs, None), ("term", over, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out, key=str)


def given(spark, docs):
    return spark.createDataFrame([(i % 3, *d, 7, "x", "y", 9, 1, 2, 3, 4) for i, d in enumerate(docs)], SHAPE)


@pytest.mark.parametrize("terms_each, sources_each", [(4096, 256), (5, 3)])
def test_equals_brute_force(spark, terms_each, sources_each):
    rng = random.Random(13)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Ünï", "zebra", "ZEBRA", "日本", "\U0001F600"]
    docs = []
    for i in range(400):
        # source s0 holds a third of all rows; ties abound, since words are few
        source = "s0" if i % 3 == 0 else f"s{rng.randrange(11)}"
        picked = rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randrange(0, 30))
        docs.append((rng.choice([" ", "1", "_", "\n"]).join(picked), rng.choice(["en", "en", "fr"]), source))
    docs += [(None, None, None), ("", "", "a"), (None, "en", None), ("a b", "rare", "one"), ("a", "rare", "two")] + [("aa bb aa", "en", "s1")] * 5
    got = divergence(given(spark, docs), least_docs=3, top=4, terms_each=terms_each, sources_each=sources_each)
    assert rows(got) == slow(docs, 3, 4)


def test_empty_and_single(spark):
    assert rows(divergence(given(spark, [("a", "en", "s")]).limit(0))) == []
    assert rows(divergence(given(spark, [("a", "en", "s")]), least_docs=1)) == []
    pair = [("a", "en", "s"), ("a b", "en", "t")]
    assert rows(divergence(given(spark, pair), least_docs=1)) == slow(pair, 1, 10)


def test_long_text_is_split_between_terms():
    text = ("Word" * 300_000 + " " + "next, " * 400_000).encode()
    found = [w for s in terms(text) for w in s]
    assert found == [b"word" * 300_000] + [b"next"] * 400_000
    assert list(terms(b"")) == []


def test_cells_sum_like_single_terms():
    rng = np.random.default_rng(1)
    for few in (3, 1_000_000):
        p, q = rng.integers(1, 10**9, few)[rng.integers(0, few, 500)], rng.integers(1, 10**9, 500)
        assert cell_distances(p, q) == sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q))
