"""YAML that is read and written in parts gives what PyYAML gives of the whole."""

import random
import tracemalloc

import pytest
import yaml
from pyspark.sql import functions as F

from textloom.operators import rebuild
from textloom.sources import trees, yaml_text

TOKENS = ["a", "b", "- ", "\n", "  ", ": ", "key: v", "'x'", '"y"', "&a ", "*a", "<<: ", "{", "}", "[", "]", ", ", "# c", "|\n", "!!set ", "!!omap ", "1", "2001-01-01", "null", "---\n", "? ", "é", "😀", "\t", "\n- ", "\n  - ", "\nb: ", "=", "\x85"]
TEXTS = ["", "a", "two\nlines\n", " x", "[T]a", "a: b", "é😀", "\n\na", "\t", "'", "\x07", "\x85", "\u2028b", "1", "x" * 130, "# c", "\ufeff", "a\r\nb"]


def _tried(read, text):
    try:
        return repr(read(text))
    except Exception as error:
        return type(error)


def test_texts_are_read_as_pyyaml_reads_them():
    rng = random.Random(4)
    for text in ["a: [1, {b: c}]\n", "- <<: 1\n", "x: {<<: {a: b}, c: d}\n", "a: 1\na: 2\n", "- [", *("".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 14))) for _ in range(3000))]:
        assert _tried(lambda t: yaml_text.load(t)[0], text) == _tried(yaml.safe_load, text), text


def test_trees_are_written_as_pyyaml_writes_them(monkeypatch):
    monkeypatch.setattr(yaml_text, "PART", 2)
    rng = random.Random(5)

    def tree(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            return {rng.choice([*TEXTS, 1, None, True]): tree(depth - 1) for _ in range(rng.randint(0, 4))}
        return [tree(depth - 1) for _ in range(rng.randint(0, 5))] if depth and kind < 0.6 else rng.choice([*TEXTS, 1, None, 1.5])

    for _ in range(1500):
        made = tree(4)
        assert "".join(yaml_text.dumped(made)) == yaml_text.whole(made)


def test_memory_of_a_large_file_stays_near_its_text():
    """Each scalar was a node: 40 bytes of memory for a byte of text and more."""
    text = "customers:\n" + "".join(f"  - number: {i}\n    name: Customer#{i:09d}\n    notes:\n      - in BUILDING\n      - 7\n" for i in range(4000))
    tracemalloc.start()
    tree, shared = yaml_text.load(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree["customers"]) == 4000 and not shared and most < 15 * len(text)


@pytest.mark.parametrize("end, error", [("", False), ("- [", True)])
def test_leaves_go_out_in_parts(spark, monkeypatch, end, error):
    content = "".join(f"- {i}a\n" for i in range(45_000)) + end
    files = spark.createDataFrame([(1, content), (2, "k: v")], "file_id long, content string")
    rows = trees.yaml_segments(files)
    assert [(r.file_id, r.n, r.last) for r in rows.groupBy("file_id").agg(F.count("*").alias("n"), F.max("seg_no").alias("last")).orderBy("file_id").collect()] == [(1, 1 if error else 45_000, 0 if error else 44_999), (2, 1, 0)]
    out = {r.file_id: r for r in rebuild.write_yaml(files, rows.where("kind <> 'error'").withColumn("translated", F.concat(F.lit("T"), "text"))).collect()}
    assert out[2].output == "k: Tv\n" and (out[1].write_error is not None if error else out[1].output.startswith("- T0a\n- T1a\n"))
