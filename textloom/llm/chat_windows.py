"""Chat formatting in budgeted windows (DataFrame functions only).

Prefix sums of turn tokens choose turn-aligned spans. Each span becomes one window: the conversation's opening system turn,
then a limited history of turns before the span, then the span itself. Assistant texts of the span are the targets; what is
repeated is masked.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts `&` is written `&amp;` and `<|` is written `&lt;|` (and
a line break in a role `&nl;`), so that no text can open or close a turn; `unescape` undoes it.

Defined cases: null role or text counts as empty; a null conv_id is a conversation of its own; turns with equal numbers (or
null ones, which come first) follow in order of role and text, repeated rows are turns of their own; a turn above the budget is
a window of its own and stays whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import string_columns

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class ChatOptions:
    budget: int = 1024  # tokens of a window
    history: int = 128  # tokens of repeated turns at most
    bound: bool = False  # count bytes, which no byte-level vocabulary exceeds, in place of words and marks


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Words and single other marks. It needs no vocabulary, and is less than what one makes of long words."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"))


def token_bound(text: Column) -> Column:
    """UTF-8 bytes: no byte-level vocabulary makes more tokens of a text, so windows that are counted so keep any such budget."""
    return F.octet_length(text)


def format_windows(conversations: DataFrame, options: ChatOptions = ChatOptions()) -> DataFrame:
    """Rows (conv_id, window_no, formatted, n_tokens, n_repeated, loss_spans): one for each window.

    `loss_spans` are [start, end) code points of the escaped target texts in `formatted`; the first `n_repeated` turns of a
    window are repeated from earlier ones.
    """
    o = options
    rows = string_columns(conversations, "conv_id", "turn", "role", "text")
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    rows = rows.withColumn("tokens", (token_bound if o.bound else token_count)(F.col("text")) + 4)
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.row_number().over(by)).withColumn("at", F.sum("tokens").over(so_far) - F.col("tokens"))
    rows = rows.withColumn("opens", (F.col("no") == 1) & (F.col("role") == "system"))
    rows = rows.withColumn("opening", F.first(F.struct("opens", "tokens")).over(so_far))
    # A span takes the turns that end in one half of the room left by the system turn and the history; with turns above half
    # the room set apart, its first turn cannot carry it beyond the whole room.
    room = F.lit(o.budget - o.history) - F.when(F.col("opening.opens"), F.col("opening.tokens")).otherwise(0)
    rows = rows.withColumn("half", F.floor(F.greatest(room, F.lit(2)) / 2))
    rows = rows.withColumn("bucket", F.floor((F.col("at") + F.col("tokens") - 1) / F.col("half"))).withColumn("large", F.col("tokens") > F.col("half"))
    starts = (F.lag("bucket", 1, -1).over(by) != F.col("bucket")) | F.col("large") | F.lag("large", 1, False).over(by)
    starts = F.when(F.col("no") == 1, True).when(F.lag("opens", 1, False).over(by), False).otherwise(starts)
    rows = rows.withColumn("starts", starts).withColumn("window_no", F.sum(F.col("starts").cast("int")).over(so_far) - 1)
    # The system turn's text stands once in each later window, on its first row.
    system = F.first(F.when(F.col("opens"), F.struct(F.lit(1).alias("no"), "role", "text", "tokens"))).over(so_far)
    rows = rows.withColumn("system", F.when(F.col("starts") & (F.col("window_no") > 0), system))
    turn = F.struct("no", "role", "text", "tokens")
    reach = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-o.history, -1)
    rows = rows.withColumn("before", F.collect_list(turn).over(reach))
    windows = rows.groupBy("conv_id", "window_no").agg(
        F.array_sort(F.collect_list(turn)).alias("fresh"),
        F.min_by("before", "no").alias("before"),
        F.min_by("system", "no").alias("system"),
    )
    later = F.concat(F.array("system"), F.filter("before", lambda t: t.no > 1))
    repeated = F.when(F.col("system").isNotNull(), later).otherwise(F.col("before"))
    windows = windows.withColumn("repeated", repeated).withColumn("turns", F.concat("repeated", "fresh"))
    windows = windows.withColumn("n_repeated", F.size("repeated"))
    head = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"))
    windows = windows.withColumn(
        "parts",
        F.transform("turns", lambda t, i: F.struct(head(t).alias("head"), escape(t.text).alias("body"), ((t.role == "assistant") & (i >= F.col("n_repeated"))).alias("target"))),
    )
    tail = f"{END}\n"
    spans = F.aggregate(
        "parts",
        F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>))"),
        lambda acc, p: F.struct(
            (acc.at + F.length(p.head) + F.length(p.body) + len(tail)).alias("at"),
            F.when(p.target, F.concat(acc.spans, F.array(F.struct((acc.at + F.length(p.head)).alias("start"), (acc.at + F.length(p.head) + F.length(p.body)).alias("end"))))).otherwise(acc.spans).alias("spans"),
        ),
        lambda acc: acc.spans,
    )
    return windows.select(
        "conv_id",
        "window_no",
        F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", F.lit(0), lambda acc, t: acc + t.tokens.cast("int")).alias("n_tokens"),
        "n_repeated",
        spans.alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted windows alone."""
    raw = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda x: x != "")
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substr(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END) - 1)
    said = lambda x: F.concat(unescape_role(role(x)), F.lit("\n"), unescape(body(x)), F.lit("\n"))
    per = windows.withColumn("raw", raw).select(
        "conv_id",
        "window_no",
        (F.size("raw") - F.col("n_repeated")).alias("n"),
        F.array_join(F.transform(F.slice("raw", F.col("n_repeated") + 1, F.size("raw")), said), "").alias("said"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s.start + 1, s.end - s.start))), "").alias("loss"),
        F.length("formatted").alias("chars"),
    )
    whole = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window_no", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
