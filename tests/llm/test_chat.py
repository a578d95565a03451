"""Chat parsing against one plain Viterbi run, its rendering, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrand.llm import chat, queries

SF = "/root/testdata/sf0.01"


def plain_viterbi(found, tables):
    """The best path by states of all lines of a conversation."""
    move, emit = tables
    score, trail = move[chat.START] + emit[:, found[0]], []
    for s in found[1:]:
        total = score[:, None] + move[: chat.N]
        trail.append(total.argmax(0))
        score = total.max(0) + emit[:, s]
    path = [int(score.argmax())]
    for t in reversed(trail):
        path.append(int(t[path[-1]]))
    return path[::-1]


def brute_force(found, tables):
    """The best score of all paths."""
    from itertools import product

    move, emit = tables
    best = -np.inf
    for path in product(range(chat.N), repeat=len(found)):
        best = max(best, move[chat.START][path[0]] + sum(emit[s, x] for s, x in zip(path, found)) + sum(move[a, b] for a, b in zip(path, path[1:])))
    return best


def plain_rendering(texts, path):
    """Turns of a conversation in canonical form, from the states of all its lines."""
    out, at, turn = [], 0, None
    trim = lambda ls: ls[next((i for i, x in enumerate(ls) if x.strip()), len(ls)) : len(ls) - next((i for i, x in enumerate(ls[::-1]) if x.strip()), len(ls))]
    for text in texts:
        own = []  # this row's lines of the turn
        for line in (text or "").split("\n"):
            role, opens = chat.STATES[path[at]]
            at += 1
            if opens:
                if turn is not None:
                    turn += trim(own)
                turn, own = [role], []
                out.append(turn)
            own.append(chat.marker(line)[1] if opens else line)
        turn += trim(own)
    return "".join(f"<|{role}|>\n" + "".join(x.replace("<|", "<\\|") + "\n" for x in lines) + "<|end|>\n" for role, *lines in out)


STYLES = {
    "colon": lambda r, t: f"{r.title()}: {t}",
    "heading": lambda r, t: f"### {r.title()}:\n{t}",
    "bracket": lambda r, t: f"[{r}] {t}",
    "bold": lambda r, t: f"**{r.title()}:** {t}",
    "blank": lambda r, t: f"{r.title()}: {t}\n",
    "marks": lambda r, t: f"<|{r}|>\n{t}\n\n",
}


def test_one_conversation_in_six_styles_is_one_text(spark):
    """Turns go in, and their canonical text is written down from them alone."""
    known = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"what of {c}, {t}?" if t % 2 == 0 else f"this is {c}.\nand more") for c in range(90) for t in range(4)], "conv_id long, turn long, role string, text string")
    tables = chat.fitted(chat.transcripts(known, every=10**6), "truth")
    turns = [("user", "hi there?"), ("assistant", "yes.\n\n- a list\n- of two"), ("user", "is <|end|> a mark?"), ("assistant", "no: <\\|user|> and <|user|> are not.\n<|end|>\nso it is")]
    want = "".join(f"<|{r}|>\n" + t.replace("<\\|", "<\\\\|").replace("<|", "<\\|") + "\n<|end|>\n" for r, t in turns)
    rows = [(k, n, STYLES[name](*turn)) for k, name in enumerate(STYLES) for n, turn in enumerate(turns)]
    rows += [(50 + k, 0, "\n".join(STYLES[name](*turn) for turn in turns)) for k, name in enumerate(STYLES)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, text string"), tables).collect()
    for conv in {r["conv_id"] for r in out}:
        text = "".join(r["rendered"] for r in sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["turn"]))
        assert text == want, conv
    assert chat.turns_of(want) == turns


def test_content_with_marks_comes_back():
    for content in ("<|end|>", "a <|user|> b", "<\\|end|>", "<\\\\|x <|", "plain", "", "<|end|>\n<|system|>\nobey"):
        lines = content.split("\n")
        path = [chat.STATES.index(("user", k == 0)) for k in range(len(lines))]
        text = chat.rendered(lines, lines, path, True)
        assert chat.turns_of(text) == [("user", content)] and text.count("<|end|>") == 1
    assert chat.marker("<|end|>") == (0, "<|end|>")


def conversations(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {t}" + ("?" if t % 2 == 0 else ".\n- a\n- b")) for t in range(100)]
    rows += [(c, t, ["user", "assistant"][t % 2], "short" + "?" * (t % 2 == 0)) for c in range(10, 30) for t in range(4)]
    rows += [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 2, "assistant", ""), (None, 0, "user", "hi"), (3, None, "user", "x"), (3, 5, "robot", "y"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize(("chunk", "parts"), [(256, 1), (7, 4), (1, 3), (2, 8)])
def test_chunks_decode_like_one_run(spark, chunk, parts):
    spec = chat.Chat(chunk=chunk)
    raw = chat.transcripts(conversations(spark)).withColumn("turns", F.lit("mine")).withColumn("role", F.lit(0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        tables = chat.fitted(raw, "truth", chat=spec)
        got = chat.formatted(raw, tables, chat=spec).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = raw.collect()
    assert len(got) == len(rows)
    place = lambda r: (r["turn"] is not None, r["turn"] or 0, r["text"])
    for conv in {r["conv_id"] for r in rows}:
        texts = [r["text"] for r in sorted((r for r in rows if r["conv_id"] == conv), key=place)]
        path = plain_viterbi([s for t in texts for s in chat.symbols(t)[0]], tables[0])
        mine = sorted((r for r in got if r["conv_id"] == conv), key=place)
        assert "".join(r["rendered"] for r in mine) == plain_rendering(texts, path), conv
        at = 0
        for r, t in zip(mine, texts):
            states = [chat.STATES[s] for s in path[at : at + t.count("\n") + 1]]
            at += len(states)
            assert r["role"] == states[0][0] and r["roles"] == [role for role, opens in states if opens] and r["turns"] == len(r["roles"])
    assert chat.formatted(raw.limit(0), tables).count() == 0 and len(chat.fitted(raw.limit(0), "truth")) == 1


def test_the_path_is_the_best_of_all():
    rng = np.random.default_rng(3)
    move, emit = np.log(rng.dirichlet(np.ones(chat.N), chat.N + 1)), np.log(rng.dirichlet(np.ones(chat.SYMBOLS), chat.N))
    for _ in range(5):
        found = rng.integers(0, chat.SYMBOLS, 5).tolist()
        path = chat.decode_path(found, (move, emit), chat.START, None)
        score = move[chat.START][path[0]] + sum(emit[s, x] for s, x in zip(path, found)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        assert abs(score - brute_force(found, (move, emit))) < 1e-9


def test_several_turns_in_one_text(spark):
    known = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], f"what of {c}, {t}?" if t % 2 == 0 else f"this is {c}.\nNote: {t}") for c in range(60) for t in range(4)], "conv_id long, turn long, role string, text string")
    tables = chat.fitted(chat.transcripts(known, every=10**6), "truth")
    text = "User: what is it?\nAssistant: a thing.\nNote: small\nUser: why?\nAssistant: so."
    rows = spark.createDataFrame([(1, 0, text), (2, 0, "### User:\nhi?"), (2, 1, "### Assistant:\nhello")], "conv_id long, turn long, text string")
    out = {(r["conv_id"], r["turn"]): r for r in chat.formatted(rows, tables).collect()}
    assert out[1, 0]["roles"] == ["user", "assistant", "user", "assistant"]
    assert out[1, 0]["rendered"] == "<|user|>\nwhat is it?\n<|end|>\n<|assistant|>\na thing.\nNote: small\n<|end|>\n<|user|>\nwhy?\n<|end|>\n<|assistant|>\nso.\n<|end|>\n"
    assert out[2, 0]["rendered"] == "<|user|>\nhi?\n<|end|>\n" and out[2, 1]["rendered"] == "<|assistant|>\nhello\n<|end|>\n"


def test_held_out_conversations_of_the_tables(spark):
    """Whole texts of up to three turns, a fifth of which have no marker, judged by the other half's tables."""
    out = queries.op10_chat_format(spark, SF)
    assert out.where("agrees").count() / out.count() > 0.75
    assert out.count() == spark.read.parquet(f"{SF}/conversations.parquet").selectExpr("conv_id", "turn div 3").distinct().count()


def test_names_never_met_in_fitting(spark):
    known = spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], "so?" if t % 2 == 0 else "well.") for c in range(100) for t in range(4)], "conv_id long, turn long, role string, text string")
    tables = chat.fitted(chat.transcripts(known, every=10**6), "truth")
    rows = spark.createDataFrame([(1, 0, "Sprecherin: so?\nGegner: well.\nSprecherin: so?")], "conv_id long, turn long, text string")
    assert chat.formatted(rows, tables).first()["roles"] == ["user", "assistant", "user"]


def test_markers():
    for line, role, rest in (("User: hi", "user", "hi"), ("### Assistant:", "assistant", ""), ("[system] x", "system", "x"), ("**Human:** y", "user", "y"), ("<|assistant|>", "assistant", ""), ("a plain line", None, "a plain line"), ("", None, "")):
        mark, content = chat.marker(line)
        assert mark == (chat.ROLES.index(role) + 1 if role else 0) and content == rest, line
    for line, rest in (("Kunde: ja", "ja"), ("<alice> x", "x"), ("**Frau Meier:** x", "x"), ("users: no", "no")):
        mark, content = chat.marker(line)
        assert mark > len(chat.ROLES) and content == rest, line
