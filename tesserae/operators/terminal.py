"""Terminals: which one it is, what it can do, and its sequences."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.sequences import TERMINALS, Terminal


def matched_terminals(env: DataFrame, rules: DataFrame) -> DataFrame:
    """session_id, term: the terminal whose rule fits a session's variables best.

    env: session_id, name, value.  rules: term, name, value (null: any), priority.  A higher
    priority wins, then a rule on a value over one on presence, then the name.
    """
    e, r = env.alias("e"), rules.alias("r")
    fits = e.join(r, (F.col("e.name") == F.col("r.name")) & (F.col("r.value").isNull() | (F.col("r.value") == F.col("e.value"))))
    rank = F.struct("r.priority", F.when(F.col("r.value").isNull(), 0).otherwise(1).alias("exact"), F.col("r.term"))
    return fits.groupBy("session_id").agg(F.max(rank)["term"].alias("term"))


def chained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """seq, template, origin: the inner terminal's sequences, else the outer one's."""
    o, i = outer.alias("o"), inner.alias("i")
    return o.join(i, "seq", "full").select("seq", F.coalesce("i.template", "o.template").alias("template"), F.when(F.col("i.template").isNotNull(), "inner").otherwise("outer").alias("origin"))


#: (mode, sequences it needs), best first.
CANVAS_LADDER = (
    ("truecolor", ("set_color_fgbg_direct", "set_color_fg_direct", "set_color_bg_direct")),
    ("240", ("set_color_fgbg_256", "set_color_fg_256", "set_color_bg_256")),
    ("16", ("set_color_fgbg_16", "set_color_fg_16", "set_color_bg_16")),
    ("16/8", ("set_color_fgbg_8", "set_color_fg_8", "set_color_bg_8", "enable_bold")),
    ("8", ("set_color_fgbg_8", "set_color_fg_8", "set_color_bg_8")),
    ("fgbg_bgfg", ("invert_colors", "reset_attributes")),
)
PIXEL_LADDER = (("kitty", ("begin_kitty_immediate_image_v1",)), ("sixels", ("begin_sixels",)), ("iterm2", ("begin_iterm2_image",)))
#: The same inside a multiplexer, where an image of that protocol needs virtual placement.
MUX_LADDER = (("kitty", ("begin_kitty_immediate_virt_image_v1",)), *PIXEL_LADDER[1:])


def best_mode(seqs: Column, ladder=CANVAS_LADDER, otherwise: str = "fgbg") -> Column:
    """The first mode of a ladder whose sequences are all in the array."""
    out = F.lit(otherwise)
    for mode, needs in reversed(ladder):
        has = F.lit(True)
        for n in needs:
            has = has & F.array_contains(seqs, n)
        out = F.when(has, mode).otherwise(out)
    return out


@dataclass(frozen=True)
class Sequence:
    """A sequence with arguments: %1 to %9 in the template, %% for a percent sign, %v for any number of them.

    kind: u8, u16 or u16hex bound an argument; pos sends it one higher; aix_fg and aix_bg
    send a pen of 0 to 15 as an attribute, fg8 and bg8 one of 0 to 7; aix_fgbg and fgbg8
    take the pen of the foreground, then that of the background.
    """

    name: str
    template: str
    n_args: int = 0
    kind: str = "u8"

    def tokens(self) -> list[str | int]:
        """Literal parts and argument numbers (0 for %v)."""
        out: list[str | int] = []
        for part in re.findall(r"%[1-9v%]|[^%]+", self.template):
            out.append("%" if part == "%%" else 0 if part == "%v" else int(part[1]) if part[0] == "%" and len(part) == 2 else part)
        return out

    @property
    def top(self) -> int:
        """The largest argument."""
        return {"u8": 0xFF, "aix_fg": 15, "aix_bg": 15, "aix_fgbg": 15, "fg8": 7, "bg8": 7, "fgbg8": 7}.get(self.kind, 0xFFFF)

    def base(self, k: int) -> int | None:
        """What is added to a pen that is sent as an attribute; None if argument k isn't one."""
        if self.kind in ("aix_fgbg", "fgbg8"):
            return 30 if k == 0 else 40
        return {"aix_fg": 30, "fg8": 30, "aix_bg": 40, "bg8": 40}.get(self.kind)

    def _shown(self, k: int, n: int) -> str | None:
        if not 0 <= n <= self.top:
            return None
        if self.kind == "pos":
            return str(n + 1)
        if self.kind == "u16hex":
            return f"{n:04x}"
        base = self.base(k)
        return str(n if base is None else n + base + (52 if n >= 8 else 0))

    def emit(self, *args: int) -> str | None:
        """The sequence with its arguments; None if their number or range is wrong."""
        many = "%v" in self.template
        if not many and len(args) != self.n_args:
            return None
        shown = [self._shown(k, a) for k, a in enumerate(args)]
        if None in shown:
            return None
        return "".join(";".join(shown) if t == 0 else shown[t - 1] if isinstance(t, int) else t for t in self.tokens())

    def parse(self, data: str) -> tuple[str, list[int], int]:
        """success, failure or again (more could follow); arguments; characters used."""
        digit = "0-9a-f" if self.kind == "u16hex" else "0-9"
        most = 4 if self.kind == "u16hex" else 5
        args: list[int] = []
        at = 0
        for k, t in enumerate(self.tokens()):
            if isinstance(t, str):
                if data[at : at + len(t)] != t:
                    return ("again" if t.startswith(data[at:]) else "failure"), [], 0
                at += len(t)
                continue
            pattern = f"[{digit}]{{1,{most}}}" if t else f"[{digit}]*(?:;[{digit}]*)*"
            m = re.match(pattern, data[at:])
            if not m:
                return ("again" if at == len(data) else "failure"), [], 0
            at += m.end()
            if at == len(data) and k < len(self.tokens()) - 1:
                return "again", [], 0
            base = 16 if self.kind == "u16hex" else 10
            args += [(int(x or "0", base) - (self.kind == "pos")) for x in m[0].split(";")]
        return "success", args, at


def emitted(seq: Sequence, args: list[Column]) -> Column:
    """The same as a column; null where an argument is out of range."""
    if len(args) != seq.n_args:
        return F.lit(None).cast("string")

    def shown(k: int, c: Column) -> Column:
        if seq.kind == "pos":
            return (c + 1).cast("string")
        if seq.kind == "u16hex":
            return F.lower(F.lpad(F.hex(c), 4, "0"))
        base = seq.base(k)
        return (c if base is None else c + base + F.when(c >= 8, 52).otherwise(0)).cast("string")

    good = F.lit(True)
    for a in args:
        good = good & a.between(0, seq.top)
    return F.when(good, F.concat(F.lit(""), *(F.lit(t) if isinstance(t, str) else shown(t - 1, args[t - 1]) for t in seq.tokens())))


def parsed(seq: Sequence, data: Column) -> tuple[Column, Column]:
    """success, failure or again, and the arguments, of text that begins with the sequence."""
    hexadecimal = seq.kind == "u16hex"
    digit, most = ("[0-9a-f]", 4) if hexadecimal else ("[0-9]", 5)
    whole, partly = "", ""
    for t in reversed(seq.tokens()):
        if isinstance(t, str):
            for c in reversed(t):
                whole, partly = re.escape(c) + whole, f"(?:{re.escape(c)}{partly})?"
        elif t:
            whole, partly = f"({digit}{{1,{most}}})" + whole, f"(?:{digit}{{1,{most}}}{partly})?"
        else:
            whole, partly = f"({digit}*(?:;{digit}*)*)" + whole, f"(?:{digit}*(?:;{digit}*)*{partly})?"
    done, going = data.rlike(f"(?s)^{whole}"), data.rlike(f"(?s)^{partly}\\z")
    n = sum(not isinstance(t, str) for t in seq.tokens())
    found = F.array(*(F.regexp_extract(data, f"(?s)^{whole}", k + 1) for k in range(n))) if n else F.array().cast("array<string>")
    if "%v" in seq.template:
        found = F.split(found[0], ";")
    number = lambda x: F.conv(F.when(x == "", "0").otherwise(x), 16 if hexadecimal else 10, 10).cast("int") - (1 if seq.kind == "pos" else 0)
    return F.when(done, "success").when(going, "again").otherwise("failure"), F.when(done, F.transform(found, number))


# --- which terminal it is -----------------------------------------------------------------------


def _version(s: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9]", "")
    return F.when(s.isNull(), -1).when(digits == "", 0).otherwise(F.when(digits != "", digits).cast("long"))


def detected(env: DataFrame, terminals: tuple[Terminal, ...] = TERMINALS) -> DataFrame:
    """session_id, term, mux, app: places in `terminals` of what a session's variables say, null for none.

    env: session_id, name, value.  TERM may be several names between dots.  A terminal counts
    if all its required rules hold, with the highest priority of the others that do; equal
    ones go to the first name of the table, then to a variant, then to the newest version.
    The rules are a table of some dozen rows that is sent to every task.
    """
    spark = env.sparkSession
    first = {}
    for k, t in enumerate(terminals):
        first.setdefault(t.name, k)
    rules = [(k, t.type, r.name, r.how, r.value, r.priority, r.required) for k, t in enumerate(terminals) for r in t.rules]
    table = spark.createDataFrame(rules, "no int, type string, var string, how string, want string, priority int, required boolean")
    known = [(k, first[t.name], 1 if t.variant else 0, int(re.sub("[^0-9]", "", t.version)) if t.version else -1, sum(r.required for r in t.rules)) for k, t in enumerate(terminals)]
    names = spark.createDataFrame(known, "no int, family int, variant int, version long, required_n int")
    values = F.when(F.upper("name") == "TERM", F.array_union(F.array("value"), F.split("value", r"\."))).otherwise(F.array("value"))
    e = env.where("value is not null").select("session_id", "name", F.explode(values).alias("value"))
    low, want = F.lower("value"), F.lower("want")
    holds = F.when(F.col("how") == "set", True).when(F.col("how") == "exact", low == want).when(F.col("how") == "prefix", F.startswith(low, want)).when(F.col("how") == "suffix", F.endswith(low, want)).otherwise(_version(F.col("value")) >= _version(F.col("want")))
    hits = e.join(F.broadcast(table), F.col("name") == F.col("var")).where(holds)
    # Rows of one rule that holds for several parts of a name count once.
    one = hits.groupBy("session_id", "no", "type").agg(F.max(F.when(~F.col("required"), F.col("priority"))).alias("pri"), F.count_distinct(F.when(F.col("required"), F.struct("var", "how", "want"))).alias("met"))
    one = one.where("pri is not null").join(F.broadcast(names), "no").where("met = required_n")
    rank = F.struct("pri", (-F.col("family")).alias("f"), "variant", "version", (-F.col("no")).alias("n"))
    best = one.groupBy("session_id", "type").agg((-F.max(rank)["n"]).alias("no"))
    pick = lambda t: F.max(F.when(F.col("type") == t, F.col("no"))).alias(t)
    found = best.groupBy("session_id").agg(*(pick(t) for t in ("term", "mux", "app")))
    return env.select("session_id").distinct().join(found, "session_id", "left")


def chain_of(chain: list[Terminal]) -> tuple[str, dict[str, tuple[str, int, str]]]:
    """Identifier and sequences of terminals within each other, the outermost first.

    An inner terminal's sequences hold; one that it inherits is the outer one's if either
    lacks it.
    """
    if not chain:
        return "dumb", {}
    out = dict(chain[0].sequences())
    for inner in chain[1:]:
        own = inner.sequences()
        both = {n: own[n] if n in own and n in out else out[n] for n in inner.inherits if n in out}
        out = {n: v for n, v in own.items() if n not in inner.inherits} | both
    return "/".join(t.identifier for t in chain), out


def identified(found: DataFrame, terminals: tuple[Terminal, ...] = TERMINALS) -> DataFrame:
    """found (of `detected`) with identifier, mode (best canvas mode), pixel_mode and passthrough.

    Only the combinations of terminals that occur are worked out; there are no more of
    them than the table allows.
    """
    combos = found.select("term", "mux", "app").distinct().collect()
    rows = []
    for c in combos:
        chain = [terminals[k] for k in (c.term, c.mux, c.app) if k is not None]
        name, seqs = chain_of(chain)
        ladder = MUX_LADDER if {"begin_tmux_passthrough", "begin_screen_passthrough"} & set(seqs) else PIXEL_LADDER
        pixel = next((m for m, needs in ladder if all(n in seqs for n in needs)), "symbols")
        mode = next((m for m, needs in CANVAS_LADDER if all(n in seqs for n in needs)), "fgbg")
        mux = next((t for t in chain if pixel in t.needs_passthrough), None)
        rows.append((c.term, c.mux, c.app, name, mode, pixel, mux.passthrough if mux else "none"))
    spark = found.sparkSession
    table = spark.createDataFrame(rows, "c_term int, c_mux int, c_app int, identifier string, mode string, pixel_mode string, passthrough string")
    same = F.col("term").eqNullSafe(F.col("c_term")) & F.col("mux").eqNullSafe(F.col("c_mux")) & F.col("app").eqNullSafe(F.col("c_app"))
    return found.join(F.broadcast(table), same).drop("c_term", "c_mux", "c_app")


def folded_replies(events: DataFrame, deadline: Column | None = None) -> DataFrame:
    """session_id and the last reply to each query before its session's end marker.

    events: session_id, seq_no, seq, value; the marker is `primary_device_attributes`.
    Events for which `deadline` (a condition: in time) doesn't hold came too late.
    """
    if deadline is not None:
        events = events.where(deadline)
    end = events.where("seq = 'primary_device_attributes'").groupBy("session_id").agg(F.min("seq_no").alias("last_no"))
    kept = events.join(end, "session_id", "left").where(F.col("last_no").isNull() | (F.col("seq_no") <= F.col("last_no")))
    return kept.groupBy("session_id", "seq").agg(F.max_by("value", "seq_no").alias("value"))
