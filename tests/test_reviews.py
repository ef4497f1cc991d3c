"""Review files with damaged, quoted, moved and repeated markers."""

from pyspark.sql import functions as F

from lexiloom.operators import rendering as R

N = 9


def _files(spark, damage, render):
    """Lines of one file per kind of damage; ``damage`` edits a list of lines."""
    rows = [(p, i, f"b{i}", "image", None, f"input/{'one' if i < 5 else 'two'}.png", f"text {i}\nsecond {i}", f"b{i}", f"text {i}", f"new {i}") for p in damage for i in range(1, N + 1)]
    blocks = spark.createDataFrame(rows, "project_id string, source_order long, id string, source_type string, page long, source_file string, raw_text string, source_block_id string, source_text string, translated_text string").withColumn("corrected_text", F.lit(None).cast("string"))
    parts = {}
    for r in sorted(render(blocks).collect(), key=lambda r: r.source_order):
        parts[r.project_id] = parts.get(r.project_id, "") + r.part
    lines = [(p, i + 1, line) for p, edit in damage.items() for i, line in enumerate(edit(parts[p].split("\n")))]
    return spark.createDataFrame(lines, "project_id string, line_no long, line string"), blocks


def _found(parsed, column="block_id"):
    texts, problems = parsed
    kept, bad = {}, {}
    for r in texts.collect():
        kept.setdefault(r.project_id, {})[int(r.block_id[1:])] = r.text
    for r in problems.collect():
        bad.setdefault(r.project_id, []).append((r.block_id and int(r.block_id[1:]), r.code))
    return kept, {p: sorted(x, key=str) for p, x in bad.items()}


def _put(lines, before, *new):
    at = lines.index(before)
    return [*lines[:at], *new, *lines[at:]]


def _without(lines, gone):
    return [x for x in lines if x != gone]


def _moved(lines, first, last, before):
    a, b = lines.index(first), lines.index(last)
    cut, rest = lines[a : b + 1], lines[:a] + lines[b + 1 :]
    return _put(rest, before, *cut)


def test_a_damaged_block_of_a_source_review_costs_only_itself(spark):
    place = "[SOURCE input/one.png]"
    damage = {
        "whole": lambda x: x,
        "foreign id": lambda x: [line.replace("[BLOCK b2]", "[BLOCK zz]") for line in x],
        "lost end": lambda x: _without(x, "[[END b3]]"),
        "foreign end": lambda x: [line.replace("[[END b3]]", "[[END zz]]") for line in x],
        "known id in a body": lambda x: _put(x, "second 2", "[BLOCK b7]", "[[END b7]]"),
        "whole block quoted": lambda x: _put(x, "second 2", place, "[BLOCK b4]", "quoted", "[[END b4]]"),
        "repeated end": lambda x: _put(x, "[[END b6]]", "[[END b2]]"),
        "repeated block": lambda x: [*x, place, "[BLOCK b3]", "again", "[[END b3]]"],
        "moved": lambda x: _moved(x, "[BLOCK b8]", "[[END b8]]", "second 1"),
        "words between": lambda x: _put(x, "[BLOCK b5]", "stray"),
        "empty": lambda x: _without(_without(x, "text 4"), "second 4"),
        "block lost": lambda x: [line for line in x if line not in ("[BLOCK b1]", "text 1", "second 1", "[[END b1]]")],
    }
    lines, blocks = _files(spark, damage, R.render_source_review)
    kept, bad = _found(R.parse_source_review(lines, blocks, span=4))
    lost = {
        "foreign id": [(2, "block_order_changed")], "lost end": [(3, "end_marker_changed")], "foreign end": [(3, "end_marker_changed")],
        "moved": [(8, "block_order_changed")], "words between": [(5, "location_changed")], "empty": [(4, "empty_text")], "block lost": [(1, "block_order_changed")],
    }
    assert bad == {**lost, "repeated block": [(None, "unexpected_content")]}
    for p in damage:
        gone = {i for i, _ in lost.get(p, [])}
        assert sorted(kept[p]) == [i for i in range(1, N + 1) if i not in gone], p
        plain = {i: t for i, t in kept[p].items() if t != f"text {i}\nsecond {i}"}
        quoted = {"known id in a body": {2}, "whole block quoted": {2}, "repeated end": {6}, "moved": {1}}.get(p, set())
        assert set(plain) == quoted, p
    assert kept["whole block quoted"][2] == f"text 2\n{place}\n[BLOCK b4]\nquoted\n[[END b4]]\nsecond 2"


def test_a_damaged_block_of_a_translation_review_costs_only_itself(spark):
    damage = {
        "whole": lambda x: x,
        "foreign id": lambda x: [line.replace("[BLOCK b2]", "[BLOCK zz]") for line in x],
        "lost end": lambda x: _without(x, "[[END b3]]"),
        "known id in a body": lambda x: _put(x, "new 2", "[BLOCK b7]", "[[END b7]]"),
        "repeated end": lambda x: _put(x, "[[END b6]]", "[[END b2]]"),
        "source changed": lambda x: [line.replace("text 4", "text four") for line in x],
        "place changed": lambda x: [line.replace("two.png", "three.png") for line in x],
        "emptied": lambda x: _without(x, "new 9"),
        "tail": lambda x: [*x, "[BLOCK zz]"],
    }
    lines, segments = _files(spark, damage, lambda b: R.render_translation_review(b, F.col("translated_text")))
    kept, bad = _found(R.parse_translation_review(lines, segments, span=4))
    lost = {
        "foreign id": [(2, "block_order_changed")], "lost end": [(3, "end_marker_changed")], "source changed": [(4, "source_changed")], "place changed": [(5, "location_changed")],
    }
    assert bad == {**lost, "tail": [(None, "unknown_block")]}
    for p in damage:
        gone = {i for i, _ in lost.get(p, [])}
        assert sorted(kept[p]) == [i for i in range(1, N + 1) if i not in gone], p
    assert kept["emptied"][9] == "" and kept["known id in a body"][2] == "[BLOCK b7]\n[[END b7]]\nnew 2" and kept["whole"][5] == "new 5"
