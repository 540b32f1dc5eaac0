"""Chat formatting in DataFrame expressions only."""

from pyspark.sql import Column, DataFrame, functions as F

BEGIN, END, NEXT = "<s>", "</s>", "<|next|>"
# Control strings begin with "<"; escaped texts hold neither "<", "[" nor "|", and a backslash only before a letter.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p")]


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its id, `formatted`, and `mask`.

    Turns are collected as structs and sorted by turn, then role, then text. Adjacent turns of one role
    become one block `<|role:R|>text<|next|>text</s>`; the string begins with `<s>`. Each control string
    starts a segment that runs to the next one, and `mask` has a run (skip, take) per segment: skip
    characters that are not trained on, then take that are, so the runs cover the whole string. Only
    texts of a `trained` role are taken. Roles and texts are escaped (see ESCAPES), so no text can
    look like a control string, and `read_chats` gives back every turn.

    A null text or role is empty; a null turn comes first; rows with a null conversation form one
    conversation. Repeated rows are turns of their own. Other columns are not read. An empty table
    gives an empty result. A conversation is one row of the result, so it must fit into memory.
    """
    row = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy(F.col(conversation).alias(conversation)).agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    around = F.transform("_turns", lambda x: x["role"])
    nothing = F.array(F.lit(None).cast("string"))
    n = F.size("_turns")
    # each turn beside its neighbours' roles; the missing ones are null
    with_roles = sorted_turns.select(
        conversation, "_turns", F.concat(nothing, F.slice(around, F.lit(1), n - 1)).alias("_before"),
        F.concat(F.slice(around, F.lit(2), n - 1), nothing).alias("_after"))
    merged = with_roles.select(conversation, F.arrays_zip("_turns", "_before", "_after").alias("_z"))

    def segment(z: Column) -> Column:
        x = z["_turns"]
        starts, ends = ~x["role"].eqNullSafe(z["_before"]), ~x["role"].eqNullSafe(z["_after"])
        head = F.when(starts, F.concat(F.lit("<|role:"), escape(x["role"]), F.lit("|>"))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.when(ends, F.lit(END)).otherwise(F.lit("")).alias("tail"),
                        x["role"].isin(*trained).alias("trained"))

    segments = merged.select(conversation, F.transform("_z", segment).alias("_segments"))

    def runs(s: Column) -> Column:
        body, tail = F.char_length(s["body"]), F.char_length(s["tail"])
        first = F.struct((F.char_length(s["head"]) + F.when(s["trained"], 0).otherwise(body)).alias("skip"),
                         F.when(s["trained"], body).otherwise(0).alias("take"))
        last = F.struct(tail.alias("skip"), F.lit(0).alias("take"))
        return F.when(tail > 0, F.array(first, last)).otherwise(F.array(first))

    begin = F.array(F.struct(F.lit(len(BEGIN)).alias("skip"), F.lit(0).alias("take")))
    return segments.select(
        conversation,
        F.concat(F.lit(BEGIN), F.array_join(F.transform("_segments", lambda s: F.concat(s["head"], s["body"], s["tail"])), "")).alias("formatted"),
        F.concat(begin, F.flatten(F.transform("_segments", runs))).alias("mask"))


def read_chats(chats: DataFrame, formatted: str = "formatted", mask: str = "mask") -> DataFrame:
    """All columns, the turns (role, text) of the formatted string, and the unescaped text under the mask."""
    blocks = F.split(F.substring(formatted, len(BEGIN) + 1, 2 ** 31 - 1), END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)  # nothing follows the last end mark

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "|>", 1)
        role = unescape(F.substring(head, len("<|role:") + 1, 2 ** 31 - 1))
        body = block.substr(F.char_length(head) + 3, F.lit(2 ** 31 - 1))
        return F.transform(F.split(body, r"<\|next\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    pieces = F.split(F.substring(formatted, 2, 2 ** 31 - 1), "<")  # without the mark's first character
    taken = F.zip_with(pieces, F.col(mask), lambda p, r: p.substr(r["skip"], r["take"]))
    return chats.withColumns({
        "turns": F.flatten(F.transform(blocks, turns)), "trained_text": unescape(F.array_join(taken, ""))})
