"""The toxicity lexicon leaves no good word out."""

from itertools import islice, product

from airloom.llm import toxicity
from airloom.llm.common import bytes_of


def learned(spark, rows):
    return toxicity.learned_lexicon(spark.createDataFrame(rows, "text string, toxic boolean").select(bytes_of().alias("text"), "toxic"))


def test_rare_insult_among_many_ordinary_words(spark):
    ordinary = " ".join("".join(w) * 3 for w in islice(product("abcdefghijklmnop", repeat=4), 4000))  # 28,000 beginnings
    rows = [(ordinary + (" zounderkite" if i < 3 else ""), True) for i in range(8)] + [(ordinary, False)] * 40
    found = learned(spark, rows)
    assert found and all("zounderkite".startswith(e) for e in found)


def test_parts_add_up(spark, monkeypatch):
    import pandas as pd

    rows = pd.DataFrame({"text": [b"alpha beta"] * 3 + [b"gamma alpha"] * 2, "toxic": [True, True, False, False, True]})
    whole = pd.concat(toxicity.beginnings(iter([rows]))).groupby("entry").sum()
    monkeypatch.setattr(toxicity, "HELD", 1)
    parts = pd.concat(toxicity.beginnings(rows.iloc[i:i + 1] for i in range(5))).groupby("entry").sum()
    assert parts.equals(whole) and whole.loc["alph"].tolist() == [3, 2]


def test_siblings_keep_entries(spark):
    rows = [("you scumbag", True)] * 100 + [("you scummy one", True)] * 16 + [("you scum", True)] * 5 + [("you fine one", False)] * 400
    lexicon = toxicity.Lexicon(learned(spark, rows))
    assert all(toxicity.hits(t.encode(), lexicon)[0] > 0 for t in ("you scumbag", "you scummy one", "you scum"))
    assert not toxicity.hits(b"scumble", lexicon)[0]


def test_losses_do_not_compound():
    toxic = {"abcdefghij"[:n]: c for n, c in zip(range(4, 11), (100, 85, 75, 65, 55, 46, 39))}
    assert set(toxicity.chosen(toxic, dict.fromkeys(toxic, 3.0))) == {"abcde"}


def test_whole_words_in_exceptions():
    lexicon = toxicity.Lexicon({"clown ": 3.0, "scumb": 3.0})
    assert toxicity.hits(b"a circus clown came", lexicon)[0] == 0 and toxicity.hits(b"a clown", lexicon)[0] == 3
    assert toxicity.hits(b"soap scumbag", lexicon)[0] == 3
