import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgeline.llm import chat, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def short(frame):
    return sorted((tuple(r)[:5] for r in frame.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    got = queries.op4_chat_windows(spark, SF)
    assert short(got) == brute(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert all(r.formatted_chars > r.loss_chars for r in got.collect())


@given(st.text(alphabet="<|>\\[]/INSTse_YASend\n", max_size=40), st.text(alphabet="a|<>\\\n", max_size=6))
def test_escape_round_trip(text, role):
    body = chat.escape(text)
    assert chat.unescape(body) == text and not any(c in body for c in chat.CONTROL)
    assert chat.parse(f"{chat._mark(role)}{body}{chat.END}" * 2) == [(role, text)] * 2


def long_rows():
    rows = [(1, 0, "system", "be brief " * 3)]
    rows += [(1, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "word " * (i * 7 % 40)) for i in range(1, 700)]
    rows += [(2, i, "assistant", "x y z " * (400 if i == 5 else 1)) for i in range(12)]
    return rows


def test_windows_keep_system_budget_and_history(spark):
    rows = long_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    budget, history = 200, 60
    found = chat.windows(turns.repartition(3), PATH, budget, history).orderBy("conv_id", "segment", "window").collect()
    assert short(chat.read_back(spark.createDataFrame(found, chat.WINDOW))) == brute(rows)
    first = [w for w in found if w.conv_id == 1]
    assert len({w.segment for w in first}) > 2
    told, system = [], ("system", "be brief " * 3)
    for k, w in enumerate(first):
        turns = chat.parse(w.text)
        repeated, new = turns[: w.n_repeated], turns[w.n_repeated :]
        assert w.n_tokens <= budget and new
        if k:
            assert repeated[0] == system
            assert repeated[1:] == told[len(told) - len(repeated) + 1 :]  # the turns just before
        told += new
        assert [w.text[s.start : s.end] for s in w.targets] == [chat.escape(t) for r, t in new if r == "assistant"]
    assert sum(w.n_repeated > 1 for w in first) > len(first) / 2
    over = [w for w in found if w.conv_id == 2 and w.n_tokens > budget]
    assert len(over) == 1 and len(chat.parse(over[0].text)) - over[0].n_repeated == 1 and over[0].n_repeated == 0


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", None), (3, None, "assistant", "n"), (3, 1, None, "r"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 0, "assistant", "é😀</s><|end|>\\"), (5, -300, "system|>", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit("s"), "c": F.lit(1), "before": F.lit(0)})
    assert short(chat.format_and_read_back(spark, turns, PATH)) == brute(rows)
    assert chat.format_and_read_back(spark, turns.limit(0), PATH).count() == 0
