"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is rendered as a sequence of turns::

    ### role: text
    </turn>

The end mark is a line of its own. ``parse_turns`` is the deterministic parser
of that grammar. A turn is first rendered as it stands and parsed back; if the
parser does not give the source turn, its text is escaped: every control string
gets one backslash more before it, which the parser takes off again. The whole
conversation is parsed once more at the end and compared with its source.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null text
or role is empty; repeated rows are turns of their own; a null conv_id is one
conversation; an empty table gives no conversations.

The digest of a conversation is taken over all of its text in order, so the turns
of one conversation meet in one row. That row is the operator's unit of output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "\n</turn>\n"
#: Control strings inside a text, with the backslashes that stand before them.
_CONTROL = r"(\\*)(###|</turn>)"
_ESCAPED = r"\\(\\*)(###|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2")


def _role_out(role: Column) -> Column:
    """Roles may hold anything: percent codes for the characters that end a header."""
    for plain, code in (("%", "%25"), (":", "%3A"), ("\n", "%0A"), ("#", "%23")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_in(role: Column) -> Column:
    for plain, code in (("#", "%23"), ("\n", "%0A"), (":", "%3A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def render_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEAD), _role_out(role), F.lit(": "), body, F.lit(END))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, body, text): ``body`` as it stands in the rendering, ``text`` without escapes."""
    pieces = F.split(formatted, END, -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def one(piece: Column) -> Column:
        cut = F.instr(piece, ": ")
        body = F.substr(piece, cut + 2)
        return F.struct(_role_in(F.substr(piece, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)).alias("role"),
                        body.alias("body"), unescape(body).alias("text"))

    return F.transform(turns, one)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, turns (parsed back), loss_mask, identical.

    ``loss_mask`` is the run-length mask over the code points of ``formatted``:
    an array of (n_chars, loss). ``identical`` says whether the parsed turns
    equal the source turns.
    """
    src = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = src.withColumn("back", parse_turns(render_turn(F.col("role"), F.col("text"))))
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text"))
    bodies = plain.select("conv_id", "turn", "role", "text", F.when(same, F.col("text")).otherwise(escape(F.col("text"))).alias("body"))
    grouped = bodies.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("src"))
    rendered = grouped.withColumn("formatted", F.array_join(F.transform("src", lambda t: render_turn(t["role"], t["body"])), ""))
    parsed = rendered.withColumn("turns", parse_turns(F.col("formatted")))
    trained = lambda t: t["role"] == trained_role
    runs = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct((F.length(_role_out(t["role"])) + len(HEAD) + 2).alias("n_chars"), F.lit(False).alias("loss")),
        F.struct(F.length(t["body"]).alias("n_chars"), trained(t).alias("loss")),
        F.struct(F.lit(len(END)).alias("n_chars"), F.lit(False).alias("loss")))))
    return parsed.select(
        "conv_id", "formatted", "turns", runs.alias("loss_mask"),
        (F.transform("src", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
         == F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("identical"))


def _starts(lengths: Column) -> Column:
    """Where each of consecutive runs starts, from 1; one element more than ``lengths``."""
    return F.aggregate(lengths, F.array(F.lit(1)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))


def _cut(text: Column, lengths: Column) -> Column:
    """The runs of ``text``, one after the other; used on short lists, as each run is searched from the start."""
    return F.transform(F.arrays_zip(F.slice(_starts(lengths), 1, F.size(lengths)).alias("at"), lengths.alias("n")),
                       lambda run: F.substr(text, run["at"], run["n"]))


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """The runs under the mask, cut out of ``formatted`` and unescaped.

    The text is first cut into as many blocks of runs as a block has runs, then each block into its
    runs, so that the work grows with the text times the root of its runs, not with their number.
    """
    n = F.size(loss_mask)
    width = F.ceil(F.sqrt(n)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda i: F.slice(loss_mask, i * width + 1, width))
    lengths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda sum_, run: sum_ + run["n_chars"]))

    def of_block(runs: Column, text: Column) -> Column:
        pieces = F.zip_with(runs, _cut(text, F.transform(runs, lambda r: r["n_chars"])),
                            lambda run, piece: F.struct(run["loss"].alias("loss"), piece.alias("piece")))
        return F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["piece"]))

    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.zip_with(blocks, _cut(formatted, lengths), of_block)))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from the formatted conversations; the loss columns through the mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "")
    read = formatted.select("conv_id", "formatted", "turns", "identical", said.alias("said"), loss.alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "identical")
