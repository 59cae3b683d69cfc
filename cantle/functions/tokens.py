"""Token-array functions as JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantle.constants import BPE_START, DIRECTIONS, EOS, PAD, SCALE_10000, SCALE_5000, SPECIAL


def _special(t: Column) -> Column:
    return (t >= SPECIAL[0]) & (t <= SPECIAL[-1])


def scale_token(scale: Column) -> Column:
    """The scale's token; other scales raise."""
    bad = F.raise_error(F.concat(F.lit("no token for scale "), scale.cast("string"))).cast("int")
    return F.when(scale == 5000, SCALE_5000).when(scale == 10000, SCALE_10000).otherwise(bad)


def eos_position(tokens: Column, eos: int = EOS) -> Column:
    """Index from 0 of the first end token, or the length."""
    at = F.array_position(tokens, eos)
    return F.when(at > 0, at - 1).otherwise(F.size(tokens)).cast("int")


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of int arrays: one code point a token, then the built-in function."""

    def text(t: Column) -> Column:
        # 256 clears the control characters; values stay below the surrogate range
        digits = F.array_join(F.transform(t, lambda x: F.lpad(F.hex((x + 256).cast("long")), 4, "0")), "")
        return F.decode(F.unhex(digits), "UTF-16BE")

    return F.levenshtein(text(a), text(b))


def token_metrics(pred: Column, target: Column, eos: int = EOS) -> dict[str, Column]:
    """The four token metrics of a prediction."""
    longest = F.greatest(F.size(pred), F.size(target), F.lit(1))
    return {
        "greedy_exact": (pred == target).cast("double"),
        "token_edit_similarity": F.lit(1.0) - edit_distance(pred, target) / longest,
        "token_length_error": F.abs(F.size(pred) - F.size(target)).cast("double"),
        "eos_position_error": F.abs(eos_position(pred, eos) - eos_position(target, eos)).cast("double"),
    }


def strip_pad(tokens: Column, pad: int = PAD) -> Column:
    """Without trailing padding."""
    kept = F.aggregate(F.transform(tokens, lambda t, i: F.when(t != pad, i + 1).otherwise(0)), F.lit(0), lambda m, x: F.greatest(m, x))
    return F.slice(tokens, F.lit(1), kept)


def equal_ignoring_pad(a: Column, b: Column) -> Column:
    return strip_pad(a) == strip_pad(b)


def normalise_labels(tokens: Column, ignored: int = -100) -> Column:
    """Ignored labels become padding."""
    return F.transform(tokens, lambda t: F.when(t == ignored, PAD).otherwise(t))


def pad_to(tokens: Column, length: Column) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(PAD), F.greatest(length - F.size(tokens), F.lit(0))))


def teacher_input(tokens: Column) -> Column:
    """All but the last token."""
    return F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))


def teacher_labels(tokens: Column) -> Column:
    """All but the first token."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def target_length(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t != PAD))


def positional_matches(a: Column, b: Column) -> Column:
    """Equal tokens at equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def adjacent_pairs(tokens: Column) -> Column:
    """Overlapping neighbours as structs (l, r)."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda x, y: F.struct(x.alias("l"), y.alias("r")))


def segments(tokens: Column, special: Column | None = None) -> Column:
    """Runs of at least two ordinary tokens between special ones."""
    is_special = (lambda t: _special(t)) if special is None else (lambda t: t == special)
    joined = F.array_join(F.transform(tokens, lambda t: F.when(is_special(t), F.lit("|")).otherwise(t.cast("string"))), ",")
    parts = F.transform(F.split(joined, "[|]"), lambda p: F.transform(F.filter(F.split(p, ","), lambda x: x != ""), lambda x: x.cast("int")))
    return F.filter(parts, lambda p: F.size(p) >= 2)


def runs(tokens: Column) -> Column:
    """Run-length form: structs (d, n)."""
    one = "array<struct<d:int,n:int>>"

    def step(out: Column, t: Column) -> Column:
        last = F.element_at(out, -1)
        grown = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(t.alias("d"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["d"] == t), grown).otherwise(F.concat(out, F.array(F.struct(t.alias("d"), F.lit(1).alias("n")))))

    return F.aggregate(tokens.cast("array<int>"), F.array().cast(one), step)


def merge_once(tokens: Column, left: int, right: int, new: int) -> Column:
    """Replace (left, right) by ``new``, left to right, without overlap."""

    def step(out: Column, t: Column) -> Column:
        hit = (t == right) & (F.try_element_at(out, F.lit(-1)) == left)
        return F.when(hit, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.lit(new)))).otherwise(F.concat(out, F.array(t)))

    return F.aggregate(tokens.cast("array<int>"), F.array().cast("array<int>"), step)


def bpe_encode(tokens: Column, by_atoms: Column, longest: int = 10) -> Column:
    """Longest match against a map from comma-joined atoms to ids; special tokens stay and break matches."""
    t = tokens.cast("array<int>")
    state = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def at(acc: Column, i: Column) -> Column:
        def widest() -> Column:
            pick = F.struct(F.lit(1).alias("w"), F.element_at(t, i).alias("id"))
            for w in range(2, longest + 1):
                key = F.array_join(F.slice(t, i, w), ",")
                found = (i + (w - 1) <= F.size(t)) & F.map_contains_key(by_atoms, key)
                pick = F.when(found, F.struct(F.lit(w).alias("w"), F.try_element_at(by_atoms, key).alias("id"))).otherwise(pick)
            return pick

        step = widest()
        moved = F.struct((i + step["w"]).alias("at"), F.concat(acc["out"], F.array(step["id"])).alias("out"))
        return F.when(i < acc["at"], acc).otherwise(moved)

    places = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, state, at, lambda s: s["out"])


def bpe_decode(tokens: Column, atoms: Column) -> Column:
    """Ids that the map of id to atoms knows are spelled out."""
    return F.flatten(F.transform(tokens.cast("array<int>"), lambda x: F.coalesce(F.try_element_at(atoms, x), F.array(x))))


def invalid_tokens(tokens: Column, atoms: Column) -> Column:
    """Number of ids that are no direction, special or vocabulary id."""
    return F.size(F.filter(tokens, lambda t: ~(((t >= 0) & (t < DIRECTIONS)) | _special(t) | ((t >= BPE_START) & F.map_contains_key(atoms, t)))))
