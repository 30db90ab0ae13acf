import hashlib

from tessel.llm import chat


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: t[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:5] for r in chat.op1(df).collect()}
    want = brute([*rows, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")])
    assert got == want


def test_reads_back_all_turns(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|", "a<", "|im_end|>", "<|", "", None, "\n\n", "é😀<|x|>", "<<|im_start|>>", "x" * 200_000]
    rows = [(i % 3, i, ["user", "assistant", "system"][i % 3] if i != 5 else None, t) for i, t in enumerate(odd * 2)]
    check(spark, rows)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_ties_repeats_odd_roles_and_other_columns(spark):
    rows = [(1, 0, "a\nb", "x"), (1, 0, "a\nb", "x"), (1, 1, "c\\n<|im_end|>\\", "y"), (2, 5, "user", "same"), (2, 5, "user", "other"), (None, 0, "assistant", "z")]
    read = [sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3]))[i] for i in range(len(rows))]
    df = spark.createDataFrame([(*r, 1, "kept out") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    got = {r[0]: tuple(r)[1:5] for r in chat.op1(df).collect()}
    mark = "<|im_end|><|im_start|>assistant ok"
    assert got == brute([*read, (-1, 0, "user", mark), (-1, 1, "assistant", mark)])


def test_the_log_of_a_table_has_all_kinds_and_folds_to_it(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    log = chat.events_of(rows)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"} and log.where("text = 'gone'").count() > 100
    turns = lambda df: sorted((r["conv_id"], r["role"], r["text"]) for r in df.collect())
    assert turns(chat.fold_events(log)) == turns(rows)


def test_events_fold(spark):
    log = [
        (1, 1, "message", 0, "user", "hello"),
        (1, 2, "message", 1, "assistant", ""),
        (1, 3, "delta", 1, "assistant", "I "),
        (1, 4, "delta", 1, "assistant", "am"),
        (1, 5, "message", 2, "user", "gone later"),
        (1, 6, "regenerate", 1, "assistant", ""),
        (1, 7, "delta", 1, "assistant", "We "),
        (1, 8, "delta", 1, "assistant", "are"),
        (1, 9, "edit", 0, "user", "hello there"),
        (1, 10, "message", 2, "user", "stays"),
        (2, 1, "delta", 0, None, None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string")
    got = sorted(tuple(r) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "hello there"), (1, 1, "assistant", "We are"), (1, 2, "user", "stays"), (2, 0, "", "")]
