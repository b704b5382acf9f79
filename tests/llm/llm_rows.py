"""Rows that every operator must take."""

LONG = "lorem ipsum dolor " * 12_000
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "a  b"), (6, "a\tb"), (7, "a b c d e f"), (7, "a b c d e f"), (8, LONG), (9, LONG), (10, LONG + "end"),
    (11, "é€😀 mixed \x00 bytes"), (12, f"start {PASSAGE} end"), (13, f"other {PASSAGE} tail"), (14, PASSAGE.replace("word30", "changed")), (15, "w" * 150_000), (16, PASSAGE.upper()),
    (17, "You are an idiot, released under the MIT License.\nLicensed under CC BY-NC 4.0."), (18, "a b c d e f"),
]
#: Names that operators use inside.
CLASHING = ("rep", "fp", "size", "key", "pack", "bucket", "slot", "shard", "_score", "_slot", "_source", "ids", "text_sha256", "frame", "length", "root")
