"""Lexicon sentiment by the published rules of Hutto and Gilbert (2014) over a small lexicon of our own.

The lexicon is a parameter (word to valence), so that a full one can be supplied; scores of the built-in one are not
those of any other package. The rules need a word's neighbours in order, so this is an Arrow-batched function.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Valences of the built-in lexicon (own values, -4 to 4).
LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 2.7, "love": 3.2, "loved": 2.9, "amazing": 2.8, "happy": 2.7, "best": 3.2, "nice": 1.8, "awesome": 3.1, "perfect": 2.7, "fast": 1.0,
    "easy": 1.9, "better": 1.9, "win": 2.8, "fun": 2.3, "enjoy": 2.2, "like": 1.5, "thanks": 1.9, "wonderful": 2.7, "bad": -2.5, "terrible": -2.1, "hate": -2.7, "awful": -2.0,
    "horrible": -2.5, "sad": -2.1, "angry": -2.3, "worst": -3.1, "poor": -2.1, "slow": -1.0, "broken": -1.5, "fail": -2.5, "failed": -2.3, "problem": -1.7, "disappointed": -2.1,
    "ugly": -2.3, "stupid": -2.4, "idiot": -2.3, "trash": -2.0, "pathetic": -2.7, "disgusting": -2.4, "worthless": -1.9, "loser": -2.4, "scum": -2.6, "moron": -2.2, "clown": -0.8,
}
BOOST = {"very": 0.293, "really": 0.293, "extremely": 0.293, "so": 0.293, "absolutely": 0.293, "totally": 0.293, "slightly": -0.293, "somewhat": -0.293, "barely": -0.293, "hardly": -0.293}
NEGATIONS = frozenset("not no never none nobody nothing neither nor cannot cant can't dont don't doesn't didn't isn't wasn't won't without".split())
_WORD = re.compile(r"[^\W_][\w']*")


def score(text: str | None, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """(compound, positive, negative, neutral); four zeros for null, (0, 0, 0, 1) where no word counts."""
    if text is None:
        return 0.0, 0.0, 0.0, 0.0
    words = _WORD.findall(text)
    shout = any(w.isupper() and len(w) > 1 for w in words) and not all(w.isupper() for w in words)
    low = [w.lower() for w in words]
    found = []
    for i, w in enumerate(low):
        v = lexicon.get(w)
        if v is None:
            found.append(0.0)
            continue
        if shout and words[i].isupper():
            v += math.copysign(0.733, v)
        for back, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= back and low[i - back] not in lexicon:
                if b := BOOST.get(low[i - back]):
                    v += math.copysign(1, v) * b * fade
                if low[i - back] in NEGATIONS:
                    v *= -0.74
        found.append(v)
    total = sum(found)
    mark = min(text.count("!"), 4) * 0.292 + (0 if text.count("?") < 2 else 0.18 * text.count("?") if text.count("?") <= 3 else 0.96)
    total += math.copysign(mark, total) if total else 0.0
    compound = total / math.sqrt(total * total + 15)
    good, bad = sum(v + 1 for v in found if v > 0), sum(v - 1 for v in found if v < 0)
    same = sum(1 for v in found if v == 0)
    if good > -bad:
        good += mark
    elif good < -bad:
        bad -= mark
    every = good - bad + same
    if not every:
        return 0.0, 0.0, 0.0, 1.0
    return round(compound, 4), round(good / every, 3), round(-bad / every, 3), round(same / every, 3)


def lexicon_sentiment(text: Column, lexicon: dict[str, float] | None = None) -> Column:
    """struct(compound, positive, negative, neutral)."""
    known = dict(LEXICON if lexicon is None else lexicon)

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([score(t if isinstance(t, str) else None, known) for t in texts], columns=["compound", "positive", "negative", "neutral"], dtype="float64")

    return F.pandas_udf(run, "compound double, positive double, negative double, neutral double")(text)
