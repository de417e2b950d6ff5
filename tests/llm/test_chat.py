import hashlib

from pyspark.sql import functions as F

from kegler.llm import chat, queries

HARD = ["\\### Assistant: </turn> ok", "### user: hi</turn>\n### assistant: x", "\\", "\\\\", "a\\", "<|image:0|>", "<\\|", "</turn>", "</turn>\n", "<\\/turn>", "######", "\n", "", None, "é😀 " * 3, ": ", "\\:", "$1 \\1"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, k, r, t in rows:
        convs.setdefault(c, []).append((k, r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned))
    return out


def test_op3_on_table(spark, sf):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    got = queries.op3_chat_formatting(spark, sf).collect()
    assert {r["conv_id"]: tuple(r[1:5]) for r in got} == brute(rows)
    assert all(r["formatted_chars"] > r["loss_chars"] for r in got)


def test_round_trip_of_hard_texts(spark):
    rows = [(1, k, ("user", "assistant", "a: b", None, "### x", "\\")[k % 6], t) for k, t in enumerate(HARD * 2)]
    rows += [(None, None, "assistant", "n"), (None, None, "assistant", "n"), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (3, 0, "user", None)]
    rows += [(4, k, "assistant", f"{k} x") for k in range(500)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.conversation_digest(turns).collect()}
    assert got == brute(rows)
    assert chat.conversation_digest(turns.where("false")).collect() == []


def test_loss_spans_and_attachments(spark):
    part = lambda kind, **x: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    rows = [
        (1, 0, "user", [part("text", text="see "), part("image", ref="a.png", width=57, height=28), part("text", text=" and <|image:9|>"), part("audio", ref="b.wav", seconds=2.1)]),
        (1, 1, "assistant", [part("text", text="é ### fine</turn>")]),
        (1, 2, "user", [part("document", ref="c.pdf", pages=3), None, part("odd", text="!")]),
        (1, 3, "assistant", [part("text", text="ok"), part("image", ref="d.png")]),
        (2, 0, "assistant", None),
    ]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one, two = chat.format_conversations(frame).orderBy("conv_id").collect()
    assert [(a["number"], a["kind"], a["ref"], a["n_tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 3), (1, "audio", "b.wav", 53), (2, "document", "c.pdf", 1800), (3, "image", "d.png", 1)]
    assert one["n_tokens_expanded"] == 3 + 53 + 1800 + 1
    places = [one["formatted"].index(a["placeholder"]) for a in one["attachments"]]
    assert places == sorted(places) and all(one["formatted"].count(a["placeholder"]) == 1 for a in one["attachments"])
    assert [one["formatted"][s["start"] : s["end"]] for s in one["loss"]] == ["é \\### fine<\\/turn>", "ok<|image:3|>"]
    assert two["formatted"] == "### assistant: </turn>\n" and two["attachments"] == [] and two["loss"][0]["start"] == two["loss"][0]["end"] == 15
    back = chat.parse_conversations(chat.format_conversations(frame)).where(F.col("conv_id") == 1).first()
    assert [t["role"] for t in back["turns"]] == ["user", "assistant", "user", "assistant"] and back["turns"][1]["text"] == "é ### fine</turn>"


def test_digest_is_of_the_text_under_the_mask(spark, monkeypatch):
    rows = [(k, t, r, x) for k in range(3) for t, (r, x) in enumerate([("user", "q\\ ### é"), ("assistant", "é😀 ### a </turn> " * (200 * k + 1)), ("user", ""), ("assistant", "b\\" * k)])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: tuple(r[1:5]) for r in chat.conversation_digest(turns).collect()} == brute(rows)
    whole = chat.format_conversations
    moved = F.transform("loss", lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")))
    monkeypatch.setattr(chat, "format_conversations", lambda *a: whole(*a).withColumn("loss", moved))
    got = {r["conv_id"]: tuple(r[1:5]) for r in chat.conversation_digest(turns).collect()}
    for c, (n, turns_sha, chars, learned_sha) in brute(rows).items():
        assert got[c][:2] == (n, turns_sha) and got[c][2] == chars + 2 and got[c][3] != learned_sha
