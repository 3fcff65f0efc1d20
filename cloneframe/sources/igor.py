"""Readers of recombination models in the published text format of inferred generation models.

A parameter file lists events (``#GeneChoice``, ``#Deletion``, ``#Insertion``, ``#DinucMarkov``) with lines ``%name;sequence;index`` or
``%value;index``; a marginals file has, per event ``@name``, its dimensions ``$Dim[..]`` and rows of values ``%v,v,..`` in the order
of the indices before the last. An anchor table gives each gene the place of its conserved residue.
"""

from __future__ import annotations

import csv
import io

import numpy as np
from pyspark.sql import SparkSession

from ..operators.background import Recombination


def parse_parameters(text: str) -> dict[str, list[list[str]]]:
    """Event nickname to its rows, each split at ';', by index. Only the event list is read."""
    out, rows = {}, None
    for line in text.splitlines():
        if line.startswith("@"):
            if line != "@Event_list":
                break
        elif line.startswith("#"):
            rows = out.setdefault(line.split(";")[-1].strip(), [])
        elif line.startswith("%") and rows is not None:
            rows.append(line[1:].strip().split(";"))
    return {k: sorted(v, key=lambda r: int(r[-1])) for k, v in out.items()}


def parse_marginals(text: str) -> dict[str, np.ndarray]:
    """Event nickname to its array."""
    values, dims, name = {}, {}, None
    for line in text.splitlines():
        if line.startswith("@"):
            name = line[1:].strip()
            values[name] = []
        elif line.startswith("$Dim"):
            dims[name] = [int(x) for x in line[line.index("[") + 1 : line.index("]")].split(",")]
        elif line.startswith("%"):
            values[name] += [float(x) for x in line[1:].split(",")]
    return {k: np.array(v).reshape(dims[k]) for k, v in values.items()}


def parse_anchors(text: str) -> dict[str, tuple[int, str]]:
    """Gene to (anchor, functionality)."""
    return {r["gene"]: (int(r["anchor_index"]), r["function"]) for r in csv.DictReader(io.StringIO(text), delimiter=";" if ";" in text.splitlines()[0] else ",")}


def model(parameters: str, marginals: str, v_anchors: str, j_anchors: str, functions: tuple[str, ...] | None = None) -> Recombination:
    """A V-D-J model from the texts of its four files. Genes without an anchor have no kept sequences; ``functions`` keeps only genes of these kinds.

    ValueError if an event of a chain with D is missing.
    """
    events, p = parse_parameters(parameters), parse_marginals(marginals)
    needed = ("v_choice", "d_gene", "j_choice", "v_3_del", "d_3_del", "d_5_del", "j_5_del", "vd_ins", "dj_ins", "vd_dinucl", "dj_dinucl")
    if lacking := [k for k in needed if k not in p]:
        raise ValueError(f"no V-D-J model: missing {', '.join(lacking)}")
    va, ja = parse_anchors(v_anchors), parse_anchors(j_anchors)
    lost = {k: [int(r[0]) for r in events[k]] for k in ("v_3_del", "d_3_del", "d_5_del", "j_5_del")}
    palindrome = {k: max(0, -min(v)) for k, v in lost.items()}
    usable = lambda table, gene: gene in table and (functions is None or table[gene][1] in functions)

    def by_loss(event: str, row: np.ndarray) -> list[float]:
        """Probabilities of losing 0, 1, .. of the extended sequence."""
        out = [0.0] * (max(lost[event]) + palindrome[event] + 1)
        for d, q in zip(lost[event], row):
            out[d + palindrome[event]] += float(q)
        return out

    v, d, j = {}, {}, {}
    for i, (gene, seq, _) in enumerate(events["v_choice"]):
        v[gene] = Recombination.trimmed(seq[va[gene][0] :], right=by_loss("v_3_del", p["v_3_del"][i]), palindrome=palindrome["v_3_del"]) if usable(va, gene) else []
    for i, (gene, seq, _) in enumerate(events["j_choice"]):
        j[gene] = Recombination.trimmed(seq[: ja[gene][0] + 3], left=by_loss("j_5_del", p["j_5_del"][i]), palindrome=palindrome["j_5_del"]) if usable(ja, gene) else []
    for i, (gene, seq, _) in enumerate(events["d_gene"]):
        kept: dict[str, float] = {}
        for a, q in enumerate(by_loss("d_5_del", p["d_5_del"][i])):
            if not q:
                continue
            row = p["d_3_del"][i][lost["d_5_del"].index(a - palindrome["d_5_del"])]
            one = [0.0] * a + [1.0]
            for text, r in Recombination.trimmed(seq, one, by_loss("d_3_del", row), palindrome["d_3_del"]):
                kept[text] = kept.get(text, 0.0) + q * r
        d[gene] = list(kept.items())
    names = {k: [r[0] for r in events[k]] for k in ("v_choice", "d_gene", "j_choice")}
    p_dj = {(names["d_gene"][b], names["j_choice"][a]): float(p["j_choice"][a] * p["d_gene"][a, b]) for a in range(len(names["j_choice"])) for b in range(len(names["d_gene"]))}
    chain = lambda k: (p[k].reshape(4, 4) / p[k].reshape(4, 4).sum(1, keepdims=True)).tolist()
    share = lambda k: (p[k].ravel() / p[k].sum()).tolist()
    return Recombination(v, d, j, dict(zip(names["v_choice"], map(float, p["v_choice"]))), p_dj, share("vd_ins"), share("dj_ins"), chain("vd_dinucl"), chain("dj_dinucl"))


def read_model(spark: SparkSession, folder: str, functions: tuple[str, ...] | None = None) -> Recombination:
    """A model from a folder with the four published files, read by Spark from any store; a model is a few hundred kilobytes."""
    text = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True).first()[0]
    return model(text("model_params.txt"), text("model_marginals.txt"), text("V_gene_CDR3_anchors.csv"), text("J_gene_CDR3_anchors.csv"), functions)
