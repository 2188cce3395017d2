"""Turn windows, sub-chunks and markdown chunks: order-dependent folds as array functions, row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_heading, is_blank, trim

# The window operator's defaults.
MIN_TURNS, MAX_TURNS, CAP, OVERLAP, CHUNK_OVERLAP = 3, 8, 3200, 1, 200


def window_bounds(lengths: Column, least: int = MIN_TURNS, most: int = MAX_TURNS, cap: int = CAP, overlap: int = OVERLAP) -> Column:
    """array<struct<first, last, oversized>> of the windows over a session's ordered turn lengths.

    A window takes up to `most` turns while they fit the cap, but never fewer than `least` for the cap's sake;
    a turn over the cap stands alone; the next window starts `overlap` turns before the end.
    """
    out = "array<struct<first:int,last:int,oversized:boolean>>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(out).alias("out"))
    step_of = F.struct(F.lit(0).alias("size"), F.lit(0).alias("chars"), F.lit(False).alias("done"))

    def extend(i: Column):
        def step(acc: Column, n: Column) -> Column:
            gap = F.when(acc["size"] > 0, 2).otherwise(0)
            stop = acc["done"] | ((acc["chars"] + gap + n > cap) & (acc["size"] >= least)) | ((n > cap) & (acc["size"] > 0))
            return F.struct(
                F.when(stop, acc["size"]).otherwise(acc["size"] + 1).cast("int").alias("size"),
                F.when(stop, acc["chars"]).otherwise(acc["chars"] + gap + n).cast("int").alias("chars"), stop.alias("done"),
            )

        return F.aggregate(F.slice(lengths, i + 1, most), step_of, step)["size"]

    def visit(acc: Column, i: Column) -> Column:
        size = extend(i)
        over = F.get(lengths, i) > cap
        last = F.when(over, i).otherwise(i + size - 1).cast("int")
        after = F.when(over, i + 1).otherwise(F.greatest(i + 1, i + size - overlap)).cast("int")
        found = F.array(F.struct(i.cast("int").alias("first"), last.alias("last"), over.alias("oversized")))
        return F.when(acc["next"] == i, F.struct(after.alias("next"), F.concat(acc["out"], found).cast(out).alias("out"))).otherwise(acc)

    places = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, visit)["out"]


#: Characters of a page; a cut looks at no more than so many at once.
PAGE = 8192


def pages(text: Column) -> Column:
    """The text in pages of PAGE characters, in one pass: a stretch of up to a page's length lies in two of them, however long the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))


def stretch(paged: Column, start: Column, length: Column) -> Column:
    """The text's characters from start on, at most PAGE of them."""
    at = F.floor(start / PAGE).cast("int")
    both = F.concat(F.coalesce(F.get(paged, at), F.lit("")), F.coalesce(F.get(paged, at + 1), F.lit("")))
    return F.substring(both, (start - at * PAGE + 1).cast("int"), length.cast("int"))


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sub_chunk_bounds(paged: Column, n: Column, cap: int = CAP, overlap: int = CHUNK_OVERLAP) -> Column:
    """array<struct<start, end>> (0-based, end excluded) of a text in pages, of n characters: cuts after a paragraph or a line past half of the cap, else hard."""
    half = cap // 2
    if cap + 2 > PAGE:
        raise ValueError(f"a chunk must fit a page of {PAGE} characters")
    rounds = F.sequence(F.lit(0), F.ceil(n / F.lit(float(half - overlap))).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        start = acc["at"]
        hard = F.least(start + cap, n)

        def end_in(part: Column) -> Column:
            # The last mark that starts at or before the hard end: reversed, the first.
            def cut(mark: str) -> Column:
                seen = F.substring(part, 1, cap + len(mark))
                last = start + cap + len(mark) - F.locate(mark, F.reverse(seen)) - len(mark) + 1
                return F.when(F.contains(seen, F.lit(mark)) & (last > start + half), last + len(mark))

            return F.least(F.coalesce(cut("\n\n"), cut("\n"), hard), n).cast("int")

        end = F.when(hard < n, _bound(stretch(paged, start, F.lit(cap + 2)), end_in)).otherwise(n.cast("int"))
        return _bound(end, lambda e: F.struct(
            F.when(e >= n, n).when(e - overlap > start, e - overlap).otherwise(e).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), e.alias("end")))).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(rounds, zero, lambda acc, k: F.when(acc["at"] >= n, acc).otherwise(step(acc, k)))["out"]


def oversized_bounds(paged: Column, n: Column, target: int = 6000) -> Column:
    """array<struct<start, end>>: cuts after the last blank line past half of the target, else hard; no overlap."""
    half = target / 2
    if target + 2 > PAGE:
        raise ValueError(f"a chunk must fit a page of {PAGE} characters")
    rounds = F.sequence(F.lit(0), F.ceil(n / F.lit(half)).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        start = acc["at"]
        hard = F.least(start + target, n)

        def end_in(part: Column) -> Column:
            last = start + F.least(F.lit(target + 2), n - start) - F.locate("\n\n", F.reverse(part)) - 1
            return F.when((hard < n) & part.contains("\n\n") & (last > start + half), last + 2).otherwise(hard).cast("int")

        return _bound(_bound(stretch(paged, start, F.lit(target + 2)), end_in), lambda e: F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), e.alias("end")))).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(rounds, zero, lambda acc, k: F.when(acc["at"] >= n, acc).otherwise(step(acc, k)))["out"]


def turn_windows(turns: DataFrame, session: str = "session_id", index: str = "turn_index", text: str = "text", carry: tuple[str, ...] = (), **options: int) -> DataFrame:
    """One row per window: session, first and last turn, number of turns, whether it is one oversized turn, and its text.

    The windows follow from the lengths alone: only those of a session meet, in order. Texts join the windows they are
    in by (session, turn), so a long session's texts are dealt over many tasks. Turns of one index go by their texts.
    carry: columns of the turns, which come as an array of structs in the column members, in order.
    """
    rows = turns.select(session, F.col(index).alias("_i"), F.col(text).alias("_t"), F.struct(F.col(index).alias("turn_index"), *carry).alias("_m"))
    rows = rows.withColumn("_again", F.row_number().over(Window.partitionBy(session, "_i").orderBy("_t")))
    ordered = rows.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("_i", "_again", F.length("_t").alias("n")))).alias("_o"))
    ordered = ordered.withColumn("_b", window_bounds(F.transform("_o", lambda t: t["n"]), **options))
    windows = F.transform("_b", lambda b: F.struct(
        F.get("_o", b["first"])["_i"].alias("first_turn"), F.get("_o", b["last"])["_i"].alias("last_turn"), (b["last"] - b["first"] + 1).alias("window_size"), b["oversized"].alias("oversized"),
        F.transform(F.slice("_o", b["first"] + 1, b["last"] - b["first"] + 1), lambda t: F.struct(t["_i"], t["_again"])).alias("of")))
    placed = ordered.select(session, windows.alias("_w")).select(session, F.posexplode("_w").alias("_no", "_w"))
    facts = ["first_turn", "last_turn", "window_size", "oversized"]
    members = placed.select(session, "_no", *[f"_w.{f}" for f in facts], F.posexplode("_w.of").alias("_k", "_of")).select("*", "_of._i", "_of._again").drop("_of")
    met = members.join(rows, [session, "_i", "_again"]).groupBy(session, "_no", *facts).agg(F.array_sort(F.collect_list(F.struct("_k", "_t", "_m"))).alias("_all"))
    more = [F.transform("_all", lambda x: x["_m"]).alias("members")] if carry else []
    return met.select(session, *facts, F.array_join(F.transform("_all", lambda x: x["_t"]), "\n\n").alias("text"), *more)


def _exploded(rows: DataFrame) -> DataFrame:
    """Rows of an outer posexplode without those of empty arrays.

    A plain one makes the optimizer look first whether the array is empty, below the columns that it is made of: it
    would be made twice more, and a text's pages anew for each step over them.
    """
    return rows.filter("chunk_no is not null")


def sub_chunks(rows: DataFrame, text: str = "text", cap: int = CAP) -> DataFrame:
    """rows, one for each sub-chunk of the text, with chunk_no, start_char, end_char; the text is the chunk's."""
    others = [c for c in rows.columns if c != text]
    cut = rows.withColumns({"_pages": pages(F.col(text)), "_n": F.length(text)}).drop(text)
    cut = cut.withColumn("_b", sub_chunk_bounds(F.col("_pages"), F.col("_n"), cap))
    pieces = F.transform("_b", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), stretch(F.col("_pages"), b["start"], b["end"] - b["start"]).alias("t")))
    out = _exploded(cut.select(*others, pieces.alias("_p")).select(*others, F.posexplode_outer("_p").alias("chunk_no", "_p")))
    named = out.select(*others, F.col("_p.t").alias(text), "chunk_no", F.col("_p.start").alias("start_char"), F.col("_p.end").alias("end_char"))
    return named.select(*rows.columns, "chunk_no", "start_char", "end_char")


def markdown_chunks(notes: DataFrame, text: str = "text", chunk_by: str = "file", large: int = 8000, target: int = 6000) -> DataFrame:
    """notes, one row for each chunk: chunk_no, section_title, content. chunk_by: file, hr-separator or h2-section."""
    content, notes = F.col(text), notes.filter(~is_blank(F.col(text)))
    if chunk_by == "file":
        notes = notes.withColumns({"_pages": F.when(F.length(content) > large, pages(content)), "_n": F.length(content)})
        pieces = F.transform(oversized_bounds(F.col("_pages"), F.col("_n"), target), lambda b: trim(stretch(F.col("_pages"), b["start"], b["end"] - b["start"])))
        parts = F.when(F.col("_n") > large, F.filter(pieces, lambda p: F.length(p) > 20)).otherwise(F.array(trim(content)))
    else:
        pattern = {"hr-separator": r"\n---+\n", "h2-section": r"(?m)(?=^## )"}[chunk_by]
        parts = F.filter(F.transform(F.split(content, pattern), trim), lambda p: F.length(p) > 20)
    cut = _exploded(notes.withColumn("_parts", parts).drop("_pages", "_n").select("*", F.posexplode_outer("_parts").alias("chunk_no", "content"))).drop("_parts")
    return cut.withColumn("section_title", first_heading(F.col("content")))


def greedy_batches(lengths: Column, most_items: int = 128, most_tokens: int = 100_000) -> Column:
    """The batch number of each of an ordered array of token estimates: a batch is full before the item that would pass a limit."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("tokens"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["items"] > 0) & ((acc["items"] >= most_items) | (acc["tokens"] + n > most_tokens))
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"]).cast("int")
        return F.struct(
            batch.alias("batch"), F.when(full, 1).otherwise(acc["items"] + 1).cast("int").alias("items"),
            F.when(full, n).otherwise(acc["tokens"] + n).cast("long").alias("tokens"), F.concat(acc["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(lengths, start, step)["out"]


def running_batches(rows: DataFrame, key: str, order: str, length: str, block: str, most_items: int = 128, most_tokens: int = 100_000) -> DataFrame:
    """(key, order, batch): the batches of one greedy fold over each key's rows by order and length, made block by block.

    `block` must not fall as `order` grows. A batch that a block takes over has at most `most_items` - 1 rows left,
    so a block states its end for each row at which its own first batch may start; those ends, one row for each
    block, are carried from block to block, and each block then numbers its rows.
    """
    # Nested, so that workers get the kernels by value.
    def starts(n: np.ndarray, at: int) -> list[int]:
        """Where batches start when one starts at `at`, and the end."""
        sums, out = np.concatenate((np.zeros(1, np.int64), np.cumsum(n))), [at]
        while out[-1] < len(n):
            s = out[-1]
            out.append(min(s + most_items, max(s + 1, int(np.searchsorted(sums, sums[s] + most_tokens, "right")) - 1), len(n)))
        return out

    def lengths(block_rows: pd.DataFrame) -> np.ndarray:
        return block_rows.sort_values([order, length])[length].to_numpy(np.int64)

    def ends(block_rows: pd.DataFrame) -> pd.DataFrame:
        n = lengths(block_rows)
        made = [starts(n, e) for e in range(min(most_items, len(n)))]
        last = [len(n) - m[-2] for m in made]
        return pd.DataFrame({
            key: block_rows[key].iloc[:1].to_numpy(), block: block_rows[block].iloc[:1].to_numpy(), "size": [len(n)], "head": [n[:most_items].tolist()],
            "made": [[len(m) - 1 for m in made]], "items": [last], "tokens": [[int(n[len(n) - x :].sum()) for x in last]],
        })

    def carried(blocks: pd.DataFrame) -> pd.DataFrame:
        out, batch, items, tokens = [], -1, 0, 0
        for b in blocks.sort_values(block).itertuples(index=False):
            b, first = b._asdict(), 0
            before = batch
            while items and first < b["size"] and items < most_items and tokens + b["head"][first] <= most_tokens:
                items, tokens, first = items + 1, tokens + int(b["head"][first]), first + 1
            if first < b["size"]:
                batch, items, tokens = batch + int(b["made"][first]), int(b["items"][first]), int(b["tokens"][first])
            out.append((first, before))
        at = blocks.sort_values(block)
        return pd.DataFrame({key: at[key], block: at[block], "first": [x for x, _ in out], "before": [x for _, x in out]})

    def numbered(block_rows: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        block_rows = block_rows.sort_values([order, length])
        first, before = int(state["first"].iloc[0]), int(state["before"].iloc[0])
        made = starts(block_rows[length].to_numpy(np.int64), first)
        batch = before + np.repeat(np.arange(len(made)), np.diff([0, *made]))
        return pd.DataFrame({key: block_rows[key], order: block_rows[order], "batch": batch.astype(np.int32)})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ids = f"`{key}` {kinds[key]}, `{block}` {kinds[block]}"
    by_block = rows.select(key, order, length, block).groupBy(key, block)
    told = by_block.applyInPandas(ends, f"{ids}, size long, head array<long>, made array<long>, items array<long>, tokens array<long>")
    state = told.groupBy(key).applyInPandas(carried, f"{ids}, first long, before long")
    return by_block.cogroup(state.groupBy(key, block)).applyInPandas(numbered, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, batch int")
