"""Tables in the shared folder."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from larkspur.llm import common


def test_a_cluster_without_a_shared_folder_raises():
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://somewhere:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_tables_are_released_but_for_the_last(spark):
    mark = common.tables_written()
    first, second, third = (common.written(spark.range(n), "numbers") for n in (3, 4, 5))
    common.release(mark, keep=1)
    assert common.tables_written() == mark + 1 and third.count() == 5
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(first.inputFiles()[0]).count()
    assert second.columns == ["id"]
    common.release(mark)
    assert common.tables_written() == mark


def test_words_that_polynomials_take_for_equal():
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer(f"{word} {other} {word.upper()}".encode(), np.uint8)
    found = common.Words(data, np.array([0, len(data)])).hash
    assert found[0] == found[2] != found[1]
