"""Each distinct prompt goes to its model once."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessel.operators.ledger import Ledger, ModelFailure


class Counting:
    """A model that notes each prompt in a file of its own, as tasks run in other processes."""

    def __init__(self, folder, reply=lambda p: f"re {p}"):
        self.folder, self.reply = str(folder), reply

    def __call__(self, prompts):
        for p in prompts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(p)
        return pd.Series([self.reply(p) for p in prompts], dtype=object)

    def seen(self):
        from pathlib import Path

        return sorted(p.read_text() for p in Path(self.folder).iterdir())


@pytest.fixture
def counting(tmp_path):
    (tmp_path / "seen").mkdir()
    return Counting(tmp_path / "seen")


def _rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, text string")


def test_each_distinct_prompt_once(spark, tmp_path, counting):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    first = ledger.call("m", counting, _rows(spark, ["a", "b", "a", None]), F.col("text"))
    assert [tuple(r) for r in first.orderBy("n").collect()] == [(0, "a", "re a"), (1, "b", "re b"), (2, "a", "re a"), (3, None, None)]
    first.count()  # a second reading asks nothing
    again = ledger.call("m", counting, _rows(spark, ["b", "c"]), F.col("text"))
    assert {r["reply"] for r in again.collect()} == {"re b", "re c"}
    assert counting.seen() == ["a", "b", "c"]
    assert [(r["n_sent"], r["n_failed"]) for r in ledger.calls("m").collect()] == [(2, 0), (1, 0)]
    ledger.call("other", counting, _rows(spark, ["a"]), F.col("text")).collect()  # another model, another reply
    assert counting.seen() == ["a", "a", "b", "c"]


def test_a_run_after_a_failure_sends_the_rest(spark, tmp_path, counting):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", attempts=1, batch=1)

    def broken(prompt):
        if prompt == "bad":
            raise ValueError("no reply")
        return prompt.upper()

    counting.reply = broken
    rows = _rows(spark, ["x", "bad", "y"])
    with pytest.raises(ModelFailure, match="1 prompts have no reply; ValueError: no reply"):
        ledger.call("m", counting, rows, F.col("text"))
    assert counting.seen() == ["bad", "x", "y"]
    lenient = ledger.call("m", counting, rows, F.col("text"), strict=False)
    assert {(r["text"], r["reply"], r["reply_error"]) for r in lenient.collect()} == {("x", "X", None), ("y", "Y", None), ("bad", None, "ValueError: no reply")}
    counting.reply = str.upper
    assert {r["reply"] for r in ledger.call("m", counting, rows, F.col("text")).collect()} == {"X", "Y", "BAD"}
    assert counting.seen() == ["bad", "bad", "bad", "x", "y"]


def test_a_flaky_model_is_tried_again(spark, tmp_path):
    (tmp_path / "tried").mkdir()
    folder = str(tmp_path / "tried")

    def flaky(prompts):
        from pathlib import Path

        name = Path(folder) / prompts.iloc[0]
        if len(prompts) > 1 or not name.exists():
            name.touch()
            raise OSError("busy")
        return prompts

    ledger = Ledger(spark, f"file://{tmp_path}/ledger", attempts=3, concurrency=1)
    assert ledger.call("m", flaky, _rows(spark, ["p", "q", "r"]), F.col("text")).where("reply = text").count() == 3


def test_structs_arrays_and_no_rows(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    vector = ledger.call("v", lambda s: s.map(lambda t: [float(len(t))] * 2), _rows(spark, ["ab"]), F.col("text"), "array<float>", "v")
    assert vector.first()["v"] == [2.0, 2.0]
    pair = ledger.call("s", lambda s: pd.DataFrame({"a": s, "n": s.map(len)}), _rows(spark, ["ab"]), F.col("text"), "struct<a:string,n:long>", "s")
    assert pair.first()["s"].asDict() == {"a": "ab", "n": 2}
    empty = ledger.call("e", lambda s: s, _rows(spark, ["x"]).where("false"), F.col("text"))
    assert empty.columns == ["n", "text", "reply"] and empty.count() == 0
    assert ledger.calls("never").count() == 0


def test_replies_of_a_wrong_number_fail(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", attempts=1)
    with pytest.raises(ModelFailure, match="0 replies to 1 prompts"):
        ledger.call("m", lambda s: [], _rows(spark, ["x"]), F.col("text"))
