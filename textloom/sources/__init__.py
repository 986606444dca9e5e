"""Readers: files (file_id, file_name, content) to ordered segment rows, one module for each kind of format."""

from .detect import detect_type, with_types
from .packages import docx_segments, epub_segments
from .text_formats import csv_segments, md_segments, srt_segments, txt_segments, vtt_segments
from .trees import game_json_segments, html_segments, json_segments, yaml_segments

EXTRACTORS = {
    "txt": txt_segments,
    "srt": srt_segments,
    "vtt": vtt_segments,
    "md": md_segments,
    "html": html_segments,
    "csv": csv_segments,
    "json": json_segments,
    "json_game": game_json_segments,
    "yaml": yaml_segments,
    "epub": epub_segments,
    "docx": docx_segments,
}

__all__ = ["EXTRACTORS", "detect_type", "with_types", *sorted(f.__name__ for f in EXTRACTORS.values())]
