import hashlib
import random

import pytest

from commstream.llm import chat_format as cf

KIND = "conv_id long, turn long, role string, text string, key string, own int"
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def templates():
    """Functions of their own, so that workers get them by value."""

    def chatml(turns):
        return "".join(f"<|im_start|>{r}\n{t.strip()}<|im_end|>\n" for r, t in turns)

    def numbered(turns):
        return "BEGIN\n" + "".join(f"[{i}] {r}> {t}\n" for i, (r, t) in enumerate(turns))

    def shortens(turns):
        """Rewrites the first turn once there are more than 40."""
        return "".join(f"{r}: {t if i or len(turns) <= 40 else '...'}\n" for i, (r, t) in enumerate(turns))

    return {"chatml": chatml, "numbered": numbered, "shortens": shortens}


def table(spark, convs):
    return spark.createDataFrame([(c, i, r, t, "x", 1) for c, turns in convs for i, (r, t) in enumerate(turns)], KIND)


def talk(n, seed=1):
    rng = random.Random(seed)
    odd = ["\\### Assistant: </turn> ok", "", "###", "\\", "a:b\n### user: x</turn>\n", "é中́", "qx0a", "za1q", "q", "0a", "hello there"]
    return [(["user", "assistant", "system", ""][i % 4], rng.choice(odd) * rng.randint(0, 2)) for i in range(n)]


def test_marked_template_reads_back(spark):
    convs = [(c, talk(n, c)) for c, n in ((1, 1), (2, 7), (3, 100), (4, 2))]
    out = {r["conv_id"]: r for r in cf.format_conversations(table(spark, convs)).collect()}
    for c, turns in convs:
        r, loss = out[c], "".join(t for role, t in turns if role == "assistant")
        assert r["formatted"] == cf.marked_template(turns) and r["formatted_chars"] == len(r["formatted"])
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["rewrites"]) == (len(loss), sha(loss), False)
        spans = [tuple(map(int, x.split(":"))) for x in r["loss_spans"].split(",") if x]
        assert "".join(cf.unescape(r["formatted"][a:b]) for a, b in spans) == loss


@pytest.mark.parametrize("template", ["chatml", "numbered"])
def test_foreign_templates(spark, template):
    template = templates()[template]
    convs = [(1, [(["user", "assistant"][i % 2], f"text number {i}") for i in range(60)]), (2, [("assistant", "")])]
    out = {r["conv_id"]: r for r in cf.format_conversations(table(spark, convs), template).collect()}
    for c, turns in convs:
        r = out[c]
        assert r["formatted"] == template(turns) and not r["rewrites"]
        spans = [tuple(map(int, x.split(":"))) for x in r["loss_spans"].split(",")]
        assert [r["formatted"][a:b] for a, b in spans] == [t for role, t in turns if role == "assistant"]
        assert r["loss_sha256"] == sha("".join(t for role, t in turns if role == "assistant"))


def test_rewrites_are_found_at_any_length(spark):
    convs = [(1, talk(40)), (2, talk(41)), (3, talk(90))]
    out = {r["conv_id"]: r["rewrites"] for r in cf.format_conversations(table(spark, convs), templates()["shortens"]).collect()}
    assert out == {1: False, 2: True, 3: True}
    with pytest.raises(cf.RewritesHistory):
        cf.turn_spans(lambda turns: f"{len(turns)} " + "".join(t for _, t in turns), [("user", "a"), ("user", "b")])


def test_hard_rows(spark):
    rows = [(1, None, "user", "last", "x", 1), (1, 3, None, None, "x", 1), (1, 3, "assistant", "long " * 200_000, "x", 1), (1, 3, None, None, "x", 1)]
    rows += [(None, 0, "user", "a", "x", 1), (None, 0, "user", "a", "x", 1), (None, 1, "assistant", "b", "x", 1)]
    out = cf.format_conversations(spark.createDataFrame(rows, KIND)).collect()
    one = next(r for r in out if r["conv_id"] == 1)
    assert one["turns_sha256"] == sha("\n\n" * 2 + "assistant\n" + "long " * 200_000 + "\n" + "user\nlast\n")
    assert sorted(r["n_turns"] for r in out if r["conv_id"] is None) == [1, 1, 1]
    assert cf.format_conversations(spark.createDataFrame([], KIND)).count() == 0


def test_query_adds_the_conversation_of_control_strings(spark, tmp_path):
    table(spark, [(5, talk(9))]).write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: r for r in cf.op5_chat_format(spark, str(tmp_path)).collect()}
    odd = "\\### Assistant: </turn> ok"
    assert (out[-7]["n_turns"], out[-7]["loss_sha256"], out[-7]["turns_sha256"]) == (2, sha(odd), sha(f"user\n{odd}\nassistant\n{odd}\n"))
    assert out[5]["n_turns"] == 9


def test_every_template_is_shown_whole_prefixes():
    seen = []

    class Watched(cf.PerTurn):
        def __call__(self, turns):
            seen.append(list(turns))
            return super().__call__(turns)

    turns = talk(6)
    now = cf._Conversation(1, Watched(cf._marked, cf.unescape, verbatim_roles=True), True)
    for role, text in turns:
        now.add(role, text)
    assert now.row()["formatted"] == cf.marked_template(turns)
    assert all(turns[:n] in seen for n in range(7))
    assert all(x[:-1] == turns[: len(x) - 1] for x in seen if x)
