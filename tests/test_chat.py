"""Conversation memory by rows of exchanges, against a model."""

import math
import random
from collections import Counter

from textloom.streaming import chat


def test_chat_retrieval_equals_model(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    turns = [(c, t, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for c in range(6) for t in range(c * 2)]
    asks = [(c * 10 + i, c, " ".join(rng.choice(words) for _ in range(4))) for c in range(7) for i in range(2)]
    posted = chat.postings(spark.createDataFrame(turns, "conv_id bigint, turn bigint, text string").repartition(3))
    assert posted.columns == ["conv_id", "turn", "dl", "b"] and posted.count() == len(turns)
    got = chat.retrieve(posted, spark.createDataFrame(asks, "qid bigint, conv_id bigint, question string"), 3)
    want = []
    for q, c, text in asks:
        own = {t: x.split() for cc, t, x in turns if cc == c}
        df = Counter(w for x in own.values() for w in set(x))
        avg = sum(map(len, own.values())) / len(own) if own else 0
        scores = {t: sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for w in text.split() if w in x) for t, x in own.items()}
        best = sorted(((round(s, 9), t) for t, s in scores.items() if s > 0), reverse=True)[:3]
        want += [(q, c, t, s, r) for r, (s, t) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
