"""Test items of every length, short ones, repetitive texts and scripts without spaces."""

import time
from itertools import combinations

import numpy as np
import pytest
from topograin.llm import decontaminate
from topograin.llm.decontaminate import Index


def found(item, text):
    return bool(Index([(1, item)]).overlaps([text]))


@pytest.mark.parametrize("n", range(1, 26))
def test_every_length_and_substitution(n):
    """The whole item with as many substitutions as its similarity allows, anywhere: all found; one more: none."""
    item = [f"w{i}" for i in range(n)]
    index = Index([(1, " ".join(item))])
    allowed = 0 if n < decontaminate.MIN_ITEM else int(n * 0.2 + 1e-9)
    every = list(combinations(range(n), allowed))
    rng = np.random.default_rng(n)
    for wrong in every if len(every) < 3000 else [every[i] for i in rng.choice(len(every), 3000, replace=False)]:
        text = ["zz", *("zz" if i in wrong else w for i, w in enumerate(item)), "zz"]
        assert index.overlaps([" ".join(text)]), wrong
    if n < decontaminate.MIN_OVERLAP:  # longer items may overlap in a part
        for wrong in combinations(range(n), allowed + 1):
            assert not index.overlaps([" ".join("zz" if i in wrong else w for i, w in enumerate(item))]), wrong


def test_repetitive_texts_take_seconds_and_bounded_memory():
    began = time.time()
    for item, text in ((["spam"] * 400, ["spam"] * 20_000), (["a", "b"] * 300, ["a", "b"] * 10_000), (["spam"] * 2000 + ["ham"], ["spam"] * 10_000)):
        (row,) = Index([(1, " ".join(item))]).overlaps([" ".join(text)])
        assert row[4] >= min(len(item) - 1, 400)
    assert time.time() - began < 30


def test_equal_items_are_one_before_blocks(spark):
    bench = spark.createDataFrame([(i, "one and the same text of the benchmark in all of its many rows") for i in range(1000, 0, -1)], "item_id long, text string")
    held = list(decontaminate.blocks(bench, "item_id", "text", 4000))
    assert len(held) == 1 and held[0].ids == [1]


def test_scripts_without_spaces():
    item = "東京都は日本の首都であり人口が最も多い都市です"
    assert found(item, "はい。" + item + "そうです") and not found(item, "全く別の文章がここに書いてあります。関係はありません。")
    assert len(decontaminate.tokens("東京 tower")) == 3
