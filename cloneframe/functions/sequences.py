"""Column functions on sequences and gene names, all inside generated code."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AMINO_ACIDS

#: IUPAC complements, both cases; the gap sign stays.
_BASES, _COMPLEMENTS = "acgtnACGTNRYSWKM.", "tgcanTGCANYRSWMK."
#: What the ambiguous bases stand for.
_MEANS = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "N": "ACGT"}
#: The standard genetic code, in the order T, C, A, G of each of the three bases.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_cdr3(c) -> Column:
    """True for strings of the twenty residues; the empty string is valid, null is not."""
    return F.coalesce(_text(c).rlike(f"^[{AMINO_ACIDS}]*$"), F.lit(False))


def allele_01(c) -> Column:
    """The gene name with its final digit made 1; names without a final digit stay."""
    return F.regexp_replace(_text(c), "[0-9]$", "1")


def reverse_complement(c) -> Column:
    """Reversed IUPAC complement; null if a letter is no base."""
    s = _text(c)
    return F.when(s.rlike("^[acgtnACGTNRYSWKM.]*$"), F.reverse(F.translate(s, _BASES, _COMPLEMENTS)))


@lru_cache(8)
def codon_table(code: str = _CODE) -> dict[str, str]:
    """Every codon of unambiguous and ambiguous bases; codons whose meanings differ are left out (X). ``code`` has the 64 residues by codon, bases in the order TCAG."""
    if len(code) != 64:
        raise ValueError("a genetic code has 64 residues")
    plain = {"".join(c): code[i] for i, c in enumerate(product("TCAG", repeat=3))}
    out = {}
    for codon in product(_MEANS, repeat=3):
        if len(found := {plain["".join(c)] for c in product(*(_MEANS[b] for b in codon))}) == 1:
            out["".join(codon)] = found.pop()
    return out


def changed_code(changes: dict[str, str], code: str = _CODE) -> str:
    """A code with the residues of some codons changed, such as {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"} for vertebrate mitochondria."""
    order = ["".join(c) for c in product("TCAG", repeat=3)]
    if unknown := [c for c in changes if c not in order]:
        raise ValueError(f"no codons: {', '.join(unknown)}")
    return "".join(changes.get(c, code[i]) for i, c in enumerate(order))


#: Letters of codons, in the order of the lookup's digits; 0 is any other letter.
_LETTERS = "".join(_MEANS) + "#"


@lru_cache(8)
def _lookup(code: str) -> str:
    """Residues by the three digits of a codon, ;-joined: # where a codon holds one, X where it has no one meaning."""
    known = codon_table(code)
    codons = ("".join(c) for c in product("?" + _LETTERS, repeat=3))
    return ";".join("#" if "#" in c else known.get(c, "X") for c in codons)


def _residue_of(codon: Column, code: str) -> Column:
    """The entry of a constant array at the number that the codon's letters spell: no search in the code."""
    digit = lambda k: F.instr(F.lit(_LETTERS), F.substr(codon, F.lit(k), F.lit(1)))
    n = len(_LETTERS) + 1
    return F.get(F.split(F.lit(_lookup(code)), ";"), (digit(1) * n + digit(2)) * n + digit(3))


def translated(c, frame: int = 1, code: str = _CODE) -> Column:
    """Residues of whole codons from frame 1 to 3, or -1 to -3 on the reverse complement, by a genetic code (``changed_code`` makes others)."""
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError("frame must be 1, 2, 3, -1, -2 or -3")
    s = F.upper(_text(c) if frame > 0 else reverse_complement(c))
    # The text is cut into codons once: an expression inside the lambda would be made anew for each of them.
    codons = F.regexp_extract_all(s if abs(frame) == 1 else F.substr(s, F.lit(abs(frame))), F.lit("(?s).{3}"), F.lit(0))
    return F.array_join(F.transform(codons, lambda x: _residue_of(x, code)), "")


def cdrs_of(aligned, ranges, gaps: bool = True) -> Column:
    """The parts of an aligned protein at ';'-joined 1-based inclusive 'start-end' ranges, with gap signs or without."""
    cut = lambda r: F.substr(
        _text(aligned), F.split_part(r, F.lit("-"), F.lit(1)).cast("int"), F.split_part(r, F.lit("-"), F.lit(2)).cast("int") - F.split_part(r, F.lit("-"), F.lit(1)).cast("int") + 1
    )
    return F.transform(F.split(_text(ranges), ";"), cut if gaps else lambda r: F.replace(cut(r), F.lit("."), F.lit("")))


def extract_percentage(summary, key: str) -> Column:
    """The number of "key (12.3%)" in a summary string; 0.0 where there is none."""
    got = F.regexp_extract(_text(summary), r"(?:^|, )\Q" + key + r"\E \(([0-9]+\.[0-9])%\)", 1)
    return F.coalesce(F.try_to_number(F.when(got != "", got), F.lit("999.9")).cast("double"), F.lit(0.0))


def regex_component(letters, max_ambiguity: int = 3) -> Column:
    """A pattern for one position from the letters seen there: none '.?', one itself, up to max '[..]', more '.'; '-' makes it optional."""
    a = F.filter(_text(letters), lambda x: x != "-")
    some = F.array_contains(_text(letters), "-")
    body = F.when(F.size(a) == 1, a[0]).when(F.size(a) <= max_ambiguity, F.concat(F.lit("["), F.array_join(a, ""), F.lit("]"))).otherwise(".")
    return F.when(F.size(a) == 0, ".?").otherwise(F.when(some, F.concat(body, F.lit("?"))).otherwise(body))


def percent_strings(weights, n: int) -> Column:
    """"b (88.6%), a (8.8%)" from an array of (weight, level), largest first, ties by level."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["w"])
    ordered = F.array_sort(weights, lambda x, y: F.when(x["w"] > y["w"], -1).when(x["w"] < y["w"], 1).when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0))
    return F.array_join(F.transform(F.slice(ordered, 1, n), lambda x: F.format_string("%s (%.1f%%)", x["k"], 100.0 * x["w"] / total)), ", ")


def midpoint_quantile(values, q: float) -> Column:
    """The quantile of an array by the mean of the two nearest ranks."""
    a = F.sort_array(_text(values))
    at = (F.size(a) - 1) * F.lit(q)
    return (F.get(a, F.floor(at).cast("int")) + F.get(a, F.ceil(at).cast("int"))) / 2
