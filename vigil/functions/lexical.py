"""Lexical features of domain names as column expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.scoring import Signal, combine
from vigil.functions.stats import string_entropy
from vigil.params import TWO_LABEL_SUFFIXES, TXT_LIKE, Lexical

#: Words whose letter pairs count as common unless a table of pairs is given.
COMMON_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "her all she there would their we him been has when who will more no if out so said what up its about into than them can only "
    "other new some could time these two may then do first any my now such like our over man me even most made after also did many "
    "before must through back years where much your way well down should because each just those people mister how too little state "
    "good very make world still own see men work long get here between both life being under never day same another know while last "
    "might us great old year off come since against go came right used take three"
)


@lru_cache(maxsize=8)
def common_pairs(words: str = COMMON_WORDS) -> tuple[str, ...]:
    """Letter pairs inside the words."""
    return tuple(sorted({w[i : i + 2] for w in words.split() for i in range(len(w) - 1)}))


def labels(name: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(name), r"^\.+|\.+$", ""), r"\."), lambda x: x != "")


def split_name(name: Column) -> dict[str, Column]:
    """registered domain, its label, and the subdomain to its left."""
    parts = F.split(F.regexp_replace(F.lower(name), r"^\.+|\.+$", ""), r"\.")
    n = F.size(parts)
    suffix = F.concat_ws(".", F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1)))
    wide = (n >= 3) & suffix.isin(*TWO_LABEL_SUFFIXES)
    keep = F.least(n, F.when(wide, 3).otherwise(2))
    return {
        "registered": F.array_join(F.slice(parts, n - keep + 1, keep), "."),
        "label": F.element_at(parts, n - keep + 1),
        "subdomain": F.array_join(F.slice(parts, F.lit(1), n - keep), "."),
    }


def rare_pairs(label: Column, pairs: tuple[str, ...] | None = None) -> Column:
    """Share of a label's letter pairs that aren't common; 1 without letter pairs, 0 below two characters."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(label) - 1, F.lit(1))), lambda i: label.substr(i, F.lit(2)))
    letters = F.filter(every, lambda p: p.rlike("^[a-z]{2}$"))
    rare = F.size(F.filter(letters, lambda p: ~p.isin(*(pairs or common_pairs()))))
    return F.when(F.length(label) < 2, 0.0).when(F.size(letters) == 0, 1.0).otherwise(rare / F.size(letters))


def digit_ratio(label: Column) -> Column:
    n = F.length(label)
    return F.when(n == 0, 0.0).otherwise(F.length(F.regexp_replace(label, "[^0-9]", "")) / n)


def dga_score(label: Column, p: Lexical = Lexical(), pairs: tuple[str, ...] | None = None) -> Column:
    """How much a label looks generated: 0 if short, else the combined lexical signals."""
    score, _ = combine([
        Signal("entropy", string_entropy(label), p.entropy_bits, p.w_entropy),
        Signal("rare_bigrams", rare_pairs(label, pairs), p.rare_bigrams, p.w_bigrams),
        Signal("digits", digit_ratio(label), p.digits, p.w_digits),
        Signal("length", F.length(label), p.long_label, p.w_length),
    ])
    return F.when(F.length(label) < p.min_label, 0.0).otherwise(score)


def max_label_length(subdomain: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(subdomain, r"\."), F.length)), F.lit(0))


def query_features(query: Column, qtype: Column, pairs: tuple[str, ...] | None = None) -> dict[str, Column]:
    """The ten features of one DNS query, in the model's order."""
    s = split_name(query)
    return {
        "label_length": F.length(s["label"]).cast("double"),
        "label_entropy": string_entropy(s["label"]),
        "digit_ratio": digit_ratio(s["label"]).cast("double"),
        "rare_bigram_ratio": rare_pairs(s["label"], pairs).cast("double"),
        "dga_score": dga_score(s["label"], pairs=pairs),
        "subdomain_max_label_len": max_label_length(s["subdomain"]).cast("double"),
        "subdomain_entropy": string_entropy(F.regexp_replace(s["subdomain"], r"\.", "")),
        "num_labels": F.size(labels(query)).cast("double"),
        "qtype": qtype.cast("double"),
        "is_txt_or_null": F.when(qtype.isin(*TXT_LIKE), 1.0).otherwise(0.0),
    }
