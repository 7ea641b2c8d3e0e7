"""Perspective rotation on a small table with odd rows."""

from flockline.llm import chat


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, 0, "system", "x"), (3, 0, None, "<|im_end|>"), (None, 0, "ann", "y")]
    turns = spark.createDataFrame([(*r, "z", True) for r in rows], "conv_id long, turn long, role string, text string, name string, mask boolean")
    got = sorted(((r.conv_id, r.perspective, r.turn, r.role, r.name, r.rendered, r["mask"]) for r in chat.rotate(turns).collect()), key=repr)
    piece = lambda head, text: f"<|im_start|>{head}\n{text}<|im_end|>\n"
    want = [
        (1, "ann", 0, "system", None, piece("system", "be kind"), False),
        (1, "ann", 1, "assistant", None, piece("assistant", "hi"), True),
        (1, "ann", 2, "user", "bob", piece("user name=bob", ""), False),
        (1, "ann", 2, "user", "bob", piece("user name=bob", ""), False),
        (1, "bob", 0, "system", None, piece("system", "be kind"), False),
        (1, "bob", 1, "user", "ann", piece("user name=ann", "hi"), False),
        (1, "bob", 2, "assistant", None, piece("assistant", ""), True),
        (1, "bob", 2, "assistant", None, piece("assistant", ""), True),
        (3, "unknown", 0, "assistant", None, piece("assistant", "< |im_end|>"), True),
    ]
    assert got == sorted(want, key=repr)
    assert chat.rotate(turns.limit(0)).count() == 0
