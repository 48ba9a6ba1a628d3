"""Chat formatting against SQL, and round trips of texts that hold its marks."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from checks.compare import differences, open_tables
from reviewlab.llm import chat
from reviewlab.llm.queries import QUERIES, SQL
from tests.conftest import SMALL

PARTS = ["<|im_start|>", "<|im_end|>", "<|nl|>", "<\\|im_end|>", "<\\\\|nl|>", "\n", "\\", "<", "|im_end|>", "assistant", "<|im_end|>\n<|im_start|>user\n", "é", ""]


def plain(rows: list[tuple]) -> dict:
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def check(df, rows: list[tuple]) -> None:
    made = chat.format_conversations(df).collect()
    want = plain(rows)
    assert Counter(r.conv_id for r in made) == Counter(want.keys())
    for r in made:
        assert r.identical and [(t.role, t.text) for t in r.turns] == want[r.conv_id]
        masked = [r.formatted[s.start:s.start + s.length] for s in r.loss_spans]
        assert masked == [t.raw for t in r.turns if t.role == "assistant"]
        marks = r.formatted.count(chat.START), r.formatted.count(chat.END)
        assert marks == (len(want[r.conv_id]),) * 2
    for r in chat.conversation_digests(chat.format_conversations(df)).collect():
        learnt = "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(want[r.conv_id]), sha("".join(f"{a}\n{b}\n" for a, b in want[r.conv_id])))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))


@pytest.mark.parametrize("seed", range(3))
def test_marks_inside_texts_and_roles(spark, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, n)))
    rows = [(c, k, "assistant" if k % 2 else word(3) if c % 3 == 0 else "user", word(6)) for c in range(400) for k in range(rnd.randint(1, 5))]
    check(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)


def test_rows_of_any_kind(spark):
    rows = [(1, None, None, None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 0, "user", ""), (None, 1, "user", "no id"),
            (2, 5, "assistant", "long <|im_end|> text " * 30000), (None, 0, "system", "first")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted int, _piece string")
    check(df, rows)
    assert chat.conversation_digests(chat.format_conversations(df.limit(0))).count() == 0


def test_only_what_conflicts_is_escaped(spark):
    rows = [(1, 0, "user", "<|nl|> and <|im_end|"), (1, 1, "assistant", "a<|im_end|>b"), (2, 0, "user", "<\\|im_end|>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert got == {1: "<|im_start|>user\n<|nl|> and <|im_end||>".replace("||>", "|<|im_end|>") + "\n<|im_start|>assistant\na<\\|im_end|>b<|im_end|>\n",
                   2: "<|im_start|>user\n<\\\\|im_end|><|im_end|>\n"}


@pytest.mark.parametrize("broken", ["x", "<|im_start|>user\nno end", "<|im_start|>user<|im_end|>\n", "<|im_start|>u\na<|im_start|>b<|im_end|>\n",
                                    "<|im_start|>u\na<|im_end|>\nrest", " <|im_start|>u\na<|im_end|>\n"])
def test_what_the_grammar_does_not_hold(value, broken):
    assert value(chat.parse(__import__("pyspark.sql.functions", fromlist=["lit"]).lit(broken))) is None


def test_query_against_sql(spark):
    name = "op11_chat_round_trip"
    assert differences(spark, open_tables(SMALL), SMALL, QUERIES[name], SQL[name]) == ""
    assert not [n for n in ("Python", "Arrow", "Pandas") if n in QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()]
