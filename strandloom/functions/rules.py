"""Ordered stem rules that fold free text to one vocabulary.

A rule list is a parameter: rows of a bucket and its stems, first match wins.
Each rule becomes one ``rlike`` in a chained CASE, so a hundred stems cost one
match.
"""
from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER, UNKNOWN = "Other", "Unknown"


class Rule(NamedTuple):
    """A bucket and its stems, each list parted by ``, ``."""

    bucket: str
    starts: str = ""  # a word begins so
    words: str = ""  # whole words
    inside: str = ""  # anywhere, also inside a word
    ends: str = ""  # a word ends so


# The tissue vocabulary, in the order in which it is tried.
TISSUE_RULES: list[Rule] = [
    Rule("Bone marrow", "bone marrow, marrow, haematopoietic, hematopoietic, hspc, cd34+"),
    Rule(
        "Blood / immune",
        "blood, pbmc, buffy coat, serum, plasma, leukocyte, leucocyte, lymphocyte, monocyte, macrophage, neutrophil, granulocyte, eosinophil, basophil, erythrocyte, erythroid, platelet, "
        "megakaryocyte, dendritic cell, nk cell, natural killer, t cell, t-cell, b cell, b-cell, cd4, cd8, treg, thymocyte, myeloid, lymphoid, lymphoblastoid, gm12878, gm18, jurkat, k562, hl-60, thp-1",
        words="lcl",
    ),
    Rule("Adrenal gland", "adrenal cortex, adrenal medulla"),
    Rule("Kidney", "renal cortex, renal medulla, kidney cortex"),
    Rule(
        "Brain / CNS",
        "brain, cerebell, cerebrum, cerebral, cortex, hippocamp, hypothalam, thalamus, striatum, midbrain, forebrain, hindbrain, amygdala, substantia nigra, neuron, neural, glia, astrocyte, "
        "oligodendrocyte, microglia, olfactory bulb, prefrontal, frontal lobe, temporal lobe, occipital, putamen",
    ),
    Rule("Nerve / spinal cord", "spinal cord, sciatic, dorsal root, drg, peripheral nerve, schwann"),
    Rule("Liver", "liver, hepatic, hepato, hepg2"),
    Rule("Lung", "lung, pulmonary, alveol, bronch, airway, a549, respiratory epithel"),
    Rule("Adrenal gland", "adrenal"),
    Rule("Kidney", "kidney, renal, nephron, podocyte, glomerul, hek293, hek 293"),
    Rule("Heart", "heart, cardiac, cardiomyocyte, myocardi, ventricle, ventricular, atrium, atrial, aortic valve"),
    Rule("Vasculature", "smooth muscle, vascular smooth"),
    Rule("Skeletal muscle", "skeletal muscle, muscle, soleus, gastrocnemius, quadriceps, tibialis, extensor digitorum, myotube, myoblast, myofib, sarcopenia, c2c12"),
    Rule("Skin", "skin, epiderm, dermis, dermal, keratinocyte, melanocyte, hair follicle, sebaceous"),
    Rule("Intestine", "intestin, colon, colorectal, ileum, ileal, jejunum, duodenum, rectum, rectal, cecum, caecum, bowel, gut, enteric, caco-2, crypt"),
    Rule("Stomach", "stomach, gastric, antrum, pylor"),
    Rule("Esophagus", "esophag, oesophag"),
    Rule("Pancreas", "pancrea, islet, beta cell, acinar"),
    Rule("Spleen", "spleen, splenic, splenocyte"),
    Rule("Thymus", "thymus, thymic"),
    Rule("Lymph node", "lymph node, lymphatic, tonsil, peyer"),
    Rule("Thyroid", "thyroid"),
    Rule("Pituitary", "pituitary, hypophys"),
    Rule("Breast / mammary", "breast, mammary, mcf-7, mcf7, mda-mb"),
    Rule("Prostate", "prostate, prostatic, lncap"),
    Rule("Testis", "testis, testes, testicular, sperm, sertoli, leydig"),
    Rule("Ovary", "ovary, ovarian, oocyte, granulosa, follicular fluid"),
    Rule("Uterus", "uterus, uterine, endometri, myometri, fallopian, oviduct"),
    Rule("Placenta", "placenta, trophoblast, chorion, decidua, amnion"),
    Rule(
        "Embryo / stem cell",
        "embryo, blastocyst, ipsc, ips cell, induced pluripotent, pluripotent, es cell, germ layer, gastrul, organoid, stem cell, zygote, morula, pronucle, blastomere, fetal, foetal",
        words="ips, esc, icm",
    ),
    Rule("Adipose", "adipose, adipocyte, fat pad, omental, subcutaneous fat, visceral fat, 3t3-l1", words="fat"),
    Rule("Bone / cartilage", "bone, osteoblast, osteoclast, osteocyte, cartilage, chondrocyte, mandible, femur, femoral bone, calvaria, vertebra, skeletal tissue"),
    Rule("Vasculature", "endothelial, huvec, umbilical vein, aorta, aortic, artery, arterial, venous, vascular, vasculature, pericyte", words="vein"),
    Rule("Eye", "retina, cornea, choroid, photoreceptor, optic", words="eye, lens", ends="rpe"),
    Rule("Bladder", "bladder, urothel, urinary"),
    Rule("Salivary gland", "salivary, parotid, submandibular gland"),
    Rule("Tumor / cancer", "tumor, tumour, cancer, malignan, metasta, neoplas, xenograft", words="pdx", inside="carcinoma, sarcoma, melanoma, lymphoma, leukemia, leukaemia, myeloma, glioma, blastoma, cytoma"),
    Rule("Reference RNA", "universal human reference, reference rna, spike-in control", words="uhrr, hbrr, ermcc, seqc, maqc"),
    Rule("Cell line", "cell line, cell-line, hela, immortalized, immortalised, 293", words="u2os, sh-sy5y, cos-7, cho, hek, hct116, ntera"),
    Rule("Cultured cells", "primary culture, fibroblast, passage", words="cells, cell, culture"),
]
PLACEHOLDERS = ("", "na", "n/a", "none", "null", "nan", "unknown", "not specified", "not applicable", "not available", "-", "--", "?")  # fixed values
WEAK = {"Cell line": 3, "Reference RNA": 3, "Cultured cells": 2, OTHER: 1, UNKNOWN: 0}  # fixed values


def expression(rule: Rule) -> str:
    """One regular expression that both engines read alike."""
    parts = []
    for stems, before, after in ((rule.starts, r"\b", ""), (rule.words, r"\b", r"\b"), (rule.inside, "", ""), (rule.ends, "", r"\b")):
        if stems:
            parts.append(before + "(" + "|".join(re.sub(r"([+.?*])", r"\\\1", s) for s in stems.split(", ")) + ")" + after)
    return "|".join(parts)


def normalised(c: Column) -> Column:
    low = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
    spaced = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, "_", " "), "/", " / "), r"\s+", " ")
    return F.when(low.isin(*PLACEHOLDERS), "").otherwise(spaced)


def canonical(c: Column, rules: Sequence[Rule] = TISSUE_RULES) -> Column:
    """Bucket of a text: Unknown for null, blank and placeholders, Other where no rule matches."""

    def chain(s: Column) -> Column:
        out = F.when(s == "", UNKNOWN)
        for rule in rules:
            out = out.when(s.rlike(expression(rule)), rule.bucket)
        return out.otherwise(OTHER)

    # As the variable of a one-element transform the normalised text is made once, not once a rule.
    return F.transform(F.array(normalised(c)), chain)[0]


def coalesced(*cs: Column) -> Column:
    """The first telling bucket of several texts; of none, the least weak, the earlier on ties."""
    buckets = F.array(*[canonical(c) for c in cs])
    weak = F.create_map(*[F.lit(x) for kv in WEAK.items() for x in kv])
    # One rank orders them all: telling buckets above weak ones, then the earlier field.
    ranked = F.transform(buckets, lambda b, i: F.struct(F.coalesce(F.try_element_at(weak, b), F.lit(9)).alias("r"), (-i).alias("i"), b.alias("b")))
    return F.array_max(ranked)["b"]


def sql_normalised(c: str) -> str:
    low = f"lower(regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g'))"
    names = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    return f"case when {low} in ({names}) then '' else regexp_replace(replace(replace({low}, '_', ' '), '/', ' / '), '\\s+', ' ', 'g') end"


def sql_canonical(c: str, rules: Sequence[Rule] = TISSUE_RULES) -> str:
    """The same CASE for the SQL check; ``c`` is a column that is already normalised."""
    return f"case when {c} = '' then 'Unknown' " + " ".join(f"when regexp_matches({c}, '{expression(r)}') then '{r.bucket}'" for r in rules) + " else 'Other' end"
