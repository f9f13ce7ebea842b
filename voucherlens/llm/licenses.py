"""Licence scan by sentence rules.

A text is cut into sentences, each sentence is normalised and looked up among
known licence sentences, and the identifiers found, in order, are matched with
ordered rules: a rule holds a sequence of identifiers that must follow one
another with at most ``gap`` other sentences between. Everything is one
projection of DataFrame functions: no shuffle, no Python, and the tables of
sentences and rules are short lists written into the plan.

A NULL or empty text has no sentences and no licences. Sentences that occur
again count again, but a licence is named once. Repeated documents each get a
row. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class LicenceRule:
    """A licence is recognised by sentence identifiers in this order."""

    licence: str
    sentences: tuple[str, ...]


# Sentences as they are written in files, by identifier. They are
# normalised as texts are before they are compared.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction."
    ),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ),
    "by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "by-notice": "Licensed under CC BY 4.0.",
    "by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "warranty-none": "The software is provided \"as is\", without warranty of any kind.",
    "all-rights": "All rights reserved.",
}

RULES = [
    LicenceRule("MIT", ("mit-notice",)),
    LicenceRule("MIT", ("mit-notice-licensed",)),
    LicenceRule("MIT", ("mit-grant", "mit-condition")),
    LicenceRule("Apache-2.0", ("apache-notice",)),
    LicenceRule("Apache-2.0", ("apache-notice", "apache-obtain")),
    LicenceRule("GPL-3.0-only", ("gpl3-notice",)),
    LicenceRule("GPL-3.0-or-later", ("gpl-free",)),
    LicenceRule("CC-BY-NC-4.0", ("by-nc-notice",)),
    LicenceRule("CC-BY-4.0", ("by-notice",)),
    LicenceRule("CC-BY-SA-4.0", ("by-sa-notice",)),
    LicenceRule("proprietary", ("all-rights",)),
]

#: Where sentences end: at a full stop, exclamation or question mark before white
#: space, and at the end of a line.
SENTENCE_END = r"(?:[.!?][ \t\r]+|[.!?]?[ \t\r]*\n)"
#: Letters and digits are kept; a dot or hyphen stays between them.
NOT_WORD = r"[^a-z0-9.\-]+"


def normalised(sentence: Column) -> Column:
    """ASCII lower case, words parted by one space, no dots or hyphens at the ends."""
    lower = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, NOT_WORD, " "), F.lit(" .-"))


def normalised_text(sentence: str) -> str:
    """:func:`normalised` for the short list of known sentences."""
    import re

    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return re.sub(NOT_WORD, " ", lower).strip(" .-")


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """For each sentence its identifier, or an empty string."""
    known = F.create_map(
        *[F.lit(x) for name, s in sentences.items() for x in (normalised_text(s), name)]
    )
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), SENTENCE_END),
        lambda s: F.coalesce(F.try_element_at(known, normalised(s)), F.lit("")),
    )


def rule_pattern(rule: LicenceRule, gap: int) -> str:
    """A regular expression over identifiers that each end with ``;``."""
    between = f"(?:[^;]*;){{0,{gap}}}"
    return "(?:^|;)" + between.join(f"{name};" for name in rule.sentences)


def scan(
    documents: DataFrame,
    *,
    sentences: dict[str, str] = SENTENCES,
    rules: list[LicenceRule] = RULES,
    gap: int = 2,
) -> DataFrame:
    """Recognised sentences in order, and the licences whose rules they fit."""
    found = documents.select("doc_id", sentence_ids(F.col("text"), sentences).alias("ids"))
    found = found.withColumn("sequence", F.concat(F.array_join("ids", ";"), F.lit(";")))
    matched = [
        F.when(F.col("sequence").rlike(rule_pattern(r, gap)), F.lit(r.licence)) for r in rules
    ]
    named = F.filter(F.col("ids"), lambda x: x != "")
    return found.select(
        "doc_id", named.alias("sentence_ids"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*matched)))).alias("licences"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )
