"""Chat formatting in budgeted windows, with DataFrame functions only.

Every turn is written between marks, with control strings inside texts escaped reversibly. Prefix sums
of the turns' tokens choose spans of whole turns: a window holds the system turn, a limited history of
the turns before its span, and the span itself, within a budget of tokens. The assistant turns of the
span are the targets of the loss; those that a window repeats are masked, so that each assistant text
counts once.

How it scales. One shuffle, by conversation. A conversation's turns are brought together, for its
windows are cut in order and its digest is one of all its text; other conversations are not.

Defined cases. Null texts and roles are empty. Turns with one number are ordered by role and text. A
turn beyond the budget has a window of its own, which is then longer. A conversation without assistant
turns has no loss. An empty table gives an empty result. Columns other than the four are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of others; a backslash goes behind their first character.
CONTROL = r"<(?=\|(?:turn|text|end|im_start|im_end|endoftext|startoftext|system|user|assistant)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    """Tokens of a turn for the budget: its runs of word characters and its other marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")).cast("long") + F.lit(4)


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per conversation: windows array<struct<formatted, turns, fresh, loss>>.

    In a window: the formatted text; for each turn its place in the conversation, whether it is fresh
    (of the span, not repeated), and whether the loss counts on its text.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    grouped = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"))

    def spans(ts: Column, first: Column) -> Column:
        """Where the windows' spans begin, from the running sum of tokens; the array is copied only there."""
        held = F.when(first == 1, ts[0]["tokens"]).otherwise(F.lit(0).cast("long"))

        def step(state: Column, t: Column) -> Column:
            i, used = state["i"], state["used"]
            room = F.lit(budget) - F.when(F.size(state["starts"]) <= 1, F.lit(0)).otherwise(F.lit(history) + held)
            new = (i == 0) | ((used > 0) & (used + t["tokens"] > room))
            return F.struct(F.when(new, t["tokens"]).otherwise(used + t["tokens"]).alias("used"), F.when(new, F.concat(state["starts"], F.array(i))).otherwise(state["starts"]).alias("starts"), (i + 1).alias("i"))

        return F.aggregate(ts, start, step, lambda s: s["starts"])

    def back(ts: Column, first: Column, begin: Column) -> Column:
        """Turns repeated before a span: back from it while their tokens stay within the history, the system turn apart.

        A turn has 4 tokens at least, so no more than history / 4 turns are looked at.
        """
        low = F.greatest(first, begin - history // 4)
        return F.aggregate(
            F.reverse(F.slice(ts, low + 1, F.greatest(begin - low, F.lit(0)))),
            F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("count")),
            lambda s, t: F.struct((s["sum"] + t["tokens"]).alias("sum"), F.when(s["sum"] + t["tokens"] <= history, s["count"] + 1).otherwise(s["count"]).alias("count")),
            lambda s: s["count"],
        )

    def numbers(low: Column, high: Column) -> Column:
        """low .. high - 1."""
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    def window(ts: Column, first: Column, begin: Column, end: Column) -> Column:
        kept = F.when(begin > 0, first).otherwise(F.lit(0))
        places = F.concat(numbers(F.lit(0), kept), let(back(ts, first, begin), lambda n: numbers(begin - n, begin)), numbers(begin, end))
        form = lambda i: let(ts[i], lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(CLOSE)))
        return let(places, lambda at: F.struct(
            F.array_join(F.transform(at, form), "").alias("formatted"),
            at.alias("turns"),
            F.transform(at, lambda i: i >= begin).alias("fresh"),
            F.transform(at, lambda i: (i >= begin) & (ts[i]["role"] == "assistant")).alias("loss"),
        ))

    def windows(ts: Column) -> Column:
        first = F.when(ts[0]["role"] == "system", F.lit(1)).otherwise(F.lit(0))
        of = lambda starts, f: F.transform(starts, lambda begin, k: window(ts, f, begin, F.coalesce(F.get(starts, k + 1), F.size(ts))))
        return let(first, lambda f: let(spans(ts, f), lambda starts: of(starts, f)))

    return grouped.select("conv_id", let(F.col("ts"), windows).alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text, loss>> in order, from the formatted texts and masks."""

    def turns(w: Column) -> Column:
        parts = F.split(w["formatted"], r"<\|end\|>")
        parsed = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p, i: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), SEP, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, SEP) + F.lit(len(SEP)))).alias("text"),
            w["fresh"][i].alias("fresh"),
            w["loss"][i].alias("loss"),
        ))
        return F.filter(parsed, lambda t: t["fresh"])

    both = let(F.col("windows"), lambda ws: F.struct(F.flatten(F.transform(ws, turns)).alias("turns"), F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w["formatted"])).alias("formatted_chars")))
    return windows.select("conv_id", both.alias("r")).select("conv_id", "r.turns", "r.formatted_chars")


def op3_chat(spark, sf_dir):
    from .common import table

    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(chat_windows(turns))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    whole = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = lambda ts: F.array_join(F.transform(F.filter(ts, lambda t: t["loss"]), lambda t: t["text"]), "")
    row = let(F.col("turns"), lambda ts: let(loss(ts), lambda x: F.struct(F.size(ts).cast("long").alias("n_turns"), digest(whole(ts)).alias("turns_sha256"), F.char_length(x).cast("long").alias("loss_chars"), digest(x).alias("loss_sha256"))))
    return back.select("conv_id", row.alias("r"), "formatted_chars").select("conv_id", "r.*", "formatted_chars")


_ESCAPED = "(length(replace({0}, chr(92), chr(92) || chr(92))) + len(regexp_extract_all({0}, '<[|](?:turn|text|end|im_start|im_end|endoftext|startoftext|system|user|assistant)[|]>|</?s>|<</?SYS>>|[[]/?INST[]]')))"
SQL = {
    "op3_chat": f"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        r AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
                   len(regexp_extract_all(text, '\\w+|[^\\w\\s]')) + 4 AS tokens,
                   23 + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} AS chars
            FROM t
        ),
        c AS (
            SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS upto,
                   first_value(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS system,
                   first_value(tokens) OVER (PARTITION BY conv_id ORDER BY i) AS tokens0,
                   first_value(chars) OVER (PARTITION BY conv_id ORDER BY i) AS chars0
            FROM r
        ),
        s AS (
            SELECT conv_id, i, tokens AS used, 1 AS spans, true AS begins FROM c WHERE i = 0
            UNION ALL
            SELECT conv_id, i, CASE WHEN new THEN tokens ELSE used + tokens END, CASE WHEN new THEN spans + 1 ELSE spans END, new
            FROM (
                SELECT c.conv_id, c.i, c.tokens, s.used, s.spans,
                       s.used > 0 AND s.used + c.tokens > 1024 - CASE WHEN s.spans <= 1 THEN 0 ELSE 256 + c.system * c.tokens0 END AS new
                FROM s JOIN c ON c.conv_id = s.conv_id AND c.i = s.i + 1
            )
        ),
        w AS (SELECT c.conv_id, c.i AS begin, c.upto - c.tokens AS before, c.system, c.chars0 FROM s JOIN c ON c.conv_id = s.conv_id AND c.i = s.i WHERE s.begins AND s.i > 0),
        h AS (
            SELECT w.conv_id, sum(c.chars) AS chars FROM w JOIN c ON c.conv_id = w.conv_id AND c.i < w.begin AND c.i >= greatest(w.system, w.begin - 64)
            WHERE w.before - (c.upto - c.tokens) <= 256 GROUP BY 1
        ),
        k AS (SELECT conv_id, sum(system * chars0) AS chars FROM w GROUP BY 1),
        g AS (
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
                   coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars
            FROM r GROUP BY 1
        )
        SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(g.chars + coalesce(h.chars, 0) + coalesce(k.chars, 0) AS BIGINT) AS formatted_chars
        FROM g LEFT JOIN h ON h.conv_id = g.conv_id LEFT JOIN k ON k.conv_id = g.conv_id
    """
}
