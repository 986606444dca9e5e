"""Writers: translated segments back to files.

Text formats are ordered joins of a file's segments. A file's segments meet in one row, as the file itself is one row.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..session import small_batches
from ..sources.trees import entries, load_shared, most_nodes, own_tasks


def _counts(segments: DataFrame) -> list[Column]:
    """Chunk counts that go along with a rebuild, so that segments are gone through once; none before the transform."""
    if "ok" not in segments.columns:
        return []
    good = F.col("translatable")
    return [F.count_if(good).alias("total_chunks"), F.count_if(good & ~F.col("ok")).alias("failed_chunks")]


def _added(frame: DataFrame) -> list[Column]:
    """The counts of a first level of groups, added up."""
    return [F.sum(c).alias(c) for c in ("total_chunks", "failed_chunks") if c in frame.columns]


def _kept(frame: DataFrame) -> list[str]:
    return [c for c in ("total_chunks", "failed_chunks") if c in frame.columns]


def _ordered(segments: DataFrame) -> DataFrame:
    """(file_id, s): a file's segments in order; attributes as JSON, which can be sorted with the rest."""
    item = F.struct("seg_no", F.coalesce("translated", "text").alias("t"), "kind", F.to_json("attrs").alias("attrs"))
    return segments.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("s"), *_counts(segments))


def _attr(item: Column, name: str) -> Column:
    return F.get_json_object(item.attrs, f"$.{name}")


def _join(segments: DataFrame, piece, separator: str) -> DataFrame:
    rows = _ordered(segments)
    text = F.array_join(F.transform("s", piece), separator)
    return rows.select("file_id", text.alias("output"), *_kept(rows))


def write_txt(segments: DataFrame) -> DataFrame:
    """Paragraphs with an empty line between; also what a word-processor document is written as."""
    return _join(segments, lambda s: s.t, "\n\n")


def write_srt(segments: DataFrame) -> DataFrame:
    def cue(s: Column, i: Column) -> Column:
        number = F.coalesce(_attr(s, "index"), (i + 1).cast("string"))
        return F.concat(number, F.lit("\n"), _attr(s, "start"), F.lit(" --> "), _attr(s, "end"), F.lit("\n"), s.t, F.lit("\n"))

    return _join(segments, cue, "\n")


def write_vtt(segments: DataFrame) -> DataFrame:
    def part(s: Column) -> Column:
        settings, name = _attr(s, "settings"), _attr(s, "identifier")
        timing = F.concat(_attr(s, "start"), F.lit(" --> "), _attr(s, "end"), F.when(settings.isNotNull(), F.concat(F.lit("  "), settings)).otherwise(""))
        cue = F.concat(F.when(name.isNotNull(), F.concat(name, F.lit("\n"))).otherwise(""), timing, F.lit("\n"), s.t, F.lit("\n"))
        return F.when(s.kind == "header", F.concat(s.t, F.lit("\n"))).otherwise(cue)

    return _join(segments, part, "\n")


def write_md(segments: DataFrame) -> DataFrame:
    return _join(segments, lambda s: s.t, "\n")


def write_html(segments: DataFrame) -> DataFrame:
    return _join(segments, lambda s: s.t, "")


def write_csv(segments: DataFrame) -> DataFrame:
    """Cells with a comma, quote or break are quoted; rows end in a line feed but for the last."""
    text = F.coalesce("translated", "text")
    cell = F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    cells = segments.select("file_id", F.col("attrs")["row"].cast("int").alias("r"), F.col("attrs")["col"].cast("int").alias("c"), cell.alias("t"), *[c for c in ("translatable", "ok") if c in segments.columns])
    rows = cells.groupBy("file_id", "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "t"))), lambda x: x.t), ",").alias("t"), *_counts(cells))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x.t), "\n").alias("output"), *_added(rows))


def replacements(segments: DataFrame) -> DataFrame:
    """(file_id, by_path): new texts by path; of a repeated path the last wins."""
    rows = segments.where("path IS NOT NULL").groupBy("file_id", "path").agg(F.max_by(F.coalesce("translated", "text"), "seg_no").alias("t"), *_counts(segments))
    return rows.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "t"))).alias("by_path"), *_added(rows))


def _replaced(tree: object, path: str, by_path: dict[str, str], keep_empty: bool, most: int, shared: bool = True) -> object:
    """A copy of the tree with the strings at known paths replaced; a stack stands for the depth, and aliases may not make it endless.

    Of a tree without shared parts what is copied is let go.
    """
    top: list[object] = [None]
    todo: list[tuple[object, str, object, object]] = [(tree, path, top, 0)]
    seen = 0
    while todo:
        here, at, holder, key = todo.pop()
        seen += 1
        if seen + len(todo) > most:
            raise ValueError(f"aliases repeat more than {most} nodes")
        if isinstance(here, str):
            found = by_path.get(at)
            holder[key] = here if found is None or (keep_empty and found == "") else found
        elif isinstance(here, list):
            holder[key] = made = [None] * len(here)
            todo += [(x, f"{at}[{i}]", made, i) for i, x in enumerate(here)]
            if not shared:
                here.clear()
        elif isinstance(here, dict):
            known = entries({str(k): v for k, v in here.items()})
            holder[key] = made = dict.fromkeys(k for k, _ in known)
            todo += [(v, f"{at}.{k}" if at else k, made, k) for k, v in known]
            if not shared:
                here.clear()
        else:
            holder[key] = int(here) if isinstance(here, float) and here.is_integer() and abs(here) < 1e21 else here
    return top[0]


def _dumped(tree: object, kind: str, shared: bool) -> str:
    if kind == "yaml":
        from ..sources import yaml_text

        return yaml_text.whole(tree) if shared else "".join(yaml_text.dumped(tree))
    return json.dumps(tree, indent=2, ensure_ascii=False)


def _write_trees(files: DataFrame, segments: DataFrame, kind: str, root: str, keep_empty: bool) -> DataFrame:
    both = own_tasks(files.select("file_id", "content").join(replacements(segments), "file_id", "left"), kind)
    counts = _kept(both)

    def written(content: str | None, by_path: pa.MapScalar) -> tuple[str | None, str | None]:
        try:
            tree, shared = load_shared(content or "", kind)
            new = dict(zip(by_path.values.field(0).to_pylist(), by_path.values.field(1).to_pylist(), strict=True)) if by_path.is_valid else {}
            return _dumped(_replaced(tree, root, new, keep_empty, most_nodes(content or ""), shared), kind, shared), None
        except Exception as error:  # a file that does not parse, or that is nested too deep for the writer
            return None, f"{kind} cannot be written: {error}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Columns as Arrow has them: as objects, the texts of a large file's map would take several times the room.
            made = [written(content.as_py(), by_path) for content, by_path in zip(batch["content"], batch["by_path"], strict=True)]
            longs = [batch[c].cast(pa.int64()) for c in ("file_id", *counts)]
            yield pa.RecordBatch.from_arrays([*longs, *(pa.array(x, pa.string()) for x in zip(*made, strict=True))] if made else [*longs, pa.array([], pa.string()), pa.array([], pa.string())], names=["file_id", *counts, "output", "write_error"])

    small_batches(files.sparkSession)
    return both.mapInArrow(write, ", ".join(["file_id long", *(f"{c} long" for c in counts), "output string", "write_error string"]))


def write_json(files: DataFrame, segments: DataFrame) -> DataFrame:
    """JSON with the strings at the segments' paths replaced; an empty translation keeps the source. `write_error` says why a file has no output."""
    return _write_trees(files, segments, "json", "root", keep_empty=True)


def write_yaml(files: DataFrame, segments: DataFrame) -> DataFrame:
    return _write_trees(files, segments, "yaml", "", keep_empty=False)


def write_game_json(files: DataFrame, segments: DataFrame, restore_tags: bool = True, always: bool = False) -> DataFrame:
    """Game JSON: tags and line breaks are restored where the source has tags (`always`: everywhere)."""
    original, new = F.col("attrs")["original"], F.coalesce("translated", "text")
    tagged = (F.col("attrs")["tags"] != "0") | F.lit(always)
    text = F.when(F.lit(restore_tags) & tagged, markup.restore(original, new)).otherwise(new)
    return _write_trees(files, segments.withColumn("translated", text), "json", "root", keep_empty=False)


def write_epub(files: DataFrame, segments: DataFrame) -> DataFrame:
    """E-books with new texts in their chapters; all else is copied, `mimetype` first and stored."""
    item = F.struct(F.col("attrs")["start"].cast("int").alias("start"), F.col("attrs")["end"].cast("int").alias("end"), F.coalesce("translated", "text").alias("t"))
    per = segments.groupBy("file_id", "path").agg(F.array_sort(F.collect_list(item)).alias("nodes"), *_counts(segments))
    per = per.groupBy("file_id").agg(F.collect_list(F.struct("path", "nodes")).alias("chapters"), *_added(per))
    both = files.select("file_id", "content").join(per, "file_id", "left")
    counts = _kept(both)

    def rebuilt(page: str, nodes) -> str:
        out, at = [], 0
        for n in nodes:
            out += [page[at : n["start"]], n["t"]]
            at = n["end"]
        return "".join([*out, page[at:]])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content, chapters in zip(batch["content"], batch["chapters"], strict=True):
                nodes = {c["path"]: c["nodes"] for c in (chapters if chapters is not None else [])}
                made = io.BytesIO()
                if content is None or not zipfile.is_zipfile(io.BytesIO(content)):
                    out.append(None)
                    continue
                with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as new:
                    infos = [i for i in old.infolist() if not i.is_dir()]
                    for info in sorted(infos, key=lambda i: i.filename != "mimetype"):
                        data = old.read(info)
                        if info.filename in nodes:
                            data = rebuilt(data.decode("utf-8", "replace"), nodes[info.filename]).encode()
                        plain = zipfile.ZipInfo(info.filename, info.date_time)
                        new.writestr(plain, data, zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
                out.append(made.getvalue())
            yield batch[["file_id", *counts]].assign(output=out)

    small_batches(files.sparkSession)
    return both.mapInPandas(write, ", ".join(["file_id long", "output binary", *(f"{c} long" for c in counts)]))


def to_tsv(segments: DataFrame) -> DataFrame:
    """(file_id, output): `path` and `source_text`, unescaped, one line for each segment."""
    line = F.concat(F.col("path"), F.lit("\t"), F.col("text"))
    rows = segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", line.alias("l")))).alias("s"))
    return rows.select("file_id", F.concat(F.lit("path\tsource_text\n"), F.array_join(F.transform("s", lambda x: x.l), "\n")).alias("output"))


def from_tsv(tsv: DataFrame) -> DataFrame:
    """Segments (file_id, seg_no, path, text, translated) of (file_id, tsv); lines without path or text are left out."""
    lines = tsv.select("file_id", F.posexplode(F.split("tsv", "\n")).alias("seg_no", "line")).where("seg_no > 0")
    parts = F.split("line", "\t")
    rows = lines.select("file_id", "seg_no", F.get(parts, F.lit(0)).alias("path"), F.get(parts, F.lit(1)).alias("translated"))
    return rows.where("path <> '' AND translated <> ''").withColumn("text", F.col("translated"))


def issue_report(issues: DataFrame, columns: list[str]) -> DataFrame:
    """(part, line): a CSV report, the header (part 0) bare and every cell quoted; for a file, write with `quoteAll`."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    rows = issues.select(F.concat_ws(",", *quoted).alias("line"))
    return rows.select(F.lit(1).alias("part"), "line").unionByName(rows.sparkSession.createDataFrame([(0, ",".join(columns))], "part int, line string"))


def write_issue_report(issues: DataFrame, columns: list[str], path: str) -> None:
    issues.select(*columns).write.option("header", True).option("quoteAll", True).csv(path)


def stored_name(key: Column) -> Column:
    """A key with eight hex digits of its own hash before the extension, the same at every run."""
    clean = F.regexp_replace(key, "^/+", "")
    digits = F.substring(F.sha2(clean, 256), 1, 8)
    dot = F.regexp_extract(clean, r"(\.[^./]*)\z", 1)
    return F.concat(F.regexp_replace(clean, r"\.[^./]*\z", ""), F.lit("_"), digits, dot)


def valid_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more; the parser by itself passes over what follows a value."""
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.try_parse_json(text).isNotNull() & member.isNotNull() & F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def game_warnings(text: Column) -> Column:
    """What a valid JSON text lacks to be a game text."""
    keys = F.json_object_keys(text)
    no_keys = ~F.coalesce(F.exists(keys, lambda k: F.contains(k, F.lit("bdat-bin"))), F.lit(False))
    found = F.array_compact(F.array(F.when(no_keys, "no-known-keys"), F.when(~F.contains(text, F.lit("[XENO:")), "no-tags")))
    return F.when(valid_json(text), found)

