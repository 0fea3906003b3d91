import random

from condnet.llm import tokens


def test_ordinary_documents_are_joined(monkeypatch):
    t = tokens.ByteBPE(f"{tokens.TOKENIZERS}/{tokens.FILES['byte_bpe_50k']}")
    joined = []
    join = tokens.ByteBPE._join
    monkeypatch.setattr(tokens.ByteBPE, "_join", lambda self, *a: joined.append(a) or join(self, *a))
    rnd = random.Random(3)
    words = ["def", "  return", "x1", "(a, b)", "=", "'s", "naïve", "\n\n", "\t", "1234", "don't", "-->", "🚀", "　"]
    for n in (500, 4000):
        s = "".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(n))
        joined.clear()
        assert t.encode(s).tolist() == t.direct(s)
        assert joined and len(s) < 1 << 16
