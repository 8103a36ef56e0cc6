"""License scans by diagonal voting.

Every run of k words of a document is hashed; the runs that pass the bit map of template hashes are joined to template
positions by their words. A joined run votes for the diagonal "document position - template position": the words of one
copy of a template all vote for the same diagonal, and words inserted or lost inside it move the rest to a diagonal
near by. Neighbouring diagonals are merged, and the merged span is verified: read along the document its places must rise,
so words in another order do not count; it must cover enough of the template's words, and all the words (or, where words
alone do not differ, runs) that tell the template from those it could be taken for. Of overlapping spans of different
labels the best covered one stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtab.llm.common import documents, query, record, texts
from loomtab.llm.wordblocks import ALNUM, Words, mixed, run_hashes, signed, slices, texts_of, windows, word_hashes, words_of


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", self.text.lower())


# The phrases every scan counts, and the notices by which public licences are granted.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
NOTICES = (
    Template("apache-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache-notice", "licensed under the Apache License, Version 2.0"),
    Template("bsd", "released under the terms of the BSD License"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by", "licensed under CC BY 4.0"),
    Template("cc-by-nc", "licensed under CC BY NC 4.0"),
    Template("cc-by-nc-nd", "licensed under CC BY NC ND 4.0"),
    Template("cc-by-nc-sa", "licensed under CC BY NC SA 4.0"),
    Template("cc-by-nd", "licensed under CC BY ND 4.0"),
    Template("cc-by-sa", "licensed under CC BY SA 4.0"),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl-notice", "licensed under the GNU General Public License, version 3"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit-notice", "released under the terms of the MIT License"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("reserved", "all rights reserved"),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)

SHORT, LONG, LONG_WORDS = 2, 4, 12


def gram_length(template: Template) -> int:
    return LONG if len(template.words()) >= LONG_WORDS else SHORT


def template_table(templates: tuple[Template, ...]) -> list[tuple]:
    """(template, label, base, k, words in all, position, gram) of every gram of every template."""
    rows = []
    for t, template in enumerate(templates):
        words, k = template.words(), gram_length(template)
        for at in range(len(words) - k + 1):
            rows.append((t, template.label, template.base, k, len(words), at, " ".join(words[at : at + k])))
    return rows


def telling(templates: tuple[Template, ...], cover: float) -> list[tuple[int, list[list[int]], list[list[int]]]]:
    """(template, words, runs) of every notice: what a span must hold. Each entry lists the word numbers, or the run's places, of which one will do.

    Compulsory are the words of a short notice that no notice of another label has; and for every notice of another label
    whose words cover enough of this one, the words that one lacks, or else the runs it lacks.
    """
    out = []
    for t, template in enumerate(templates):
        words, k, need, runs = template.words(), gram_length(template), set(), set()
        grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
        if template.base:
            out.append((t, [], []))  # a phrase counts by all its words anyway
            continue
        others = [u.words() for u in templates if not u.base and u.label != template.label]
        if len(words) < LONG_WORDS:
            need |= set(words) - {w for other in others for w in other}
        for other in others:
            lacks = set(words) - set(other)
            if sum(w not in lacks for w in words) >= cover * len(words):
                need |= lacks
                if not lacks:
                    runs |= set(grams) - {" ".join(other[i : i + k]) for i in range(len(other) - k + 1)}
        spots = [[i for i, w in enumerate(words) if w == n] for n in sorted(need)]
        out.append((t, spots, [[i for i, g in enumerate(grams) if g == r] for r in sorted(runs)]))
    return out


def _grams(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """A row without a gram for every document, and a row for every word run that may be a template's."""
    wanted = {k: sorted({row[6] for row in template_table(templates) if row[3] == k}) for k in (SHORT, LONG)}

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("check", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("gram", pa.string())])
        maps = {}
        for k, grams in wanted.items():
            part = texts_of(pa.array(grams, pa.string()))
            words = words_of(part, ALNUM)
            hashes = windows(word_hashes(part, words), words.owner, k)[1]
            map_ = np.zeros(1 << 20, bool)
            map_[(hashes >> np.uint64(44)).astype(np.int64)] = True
            maps[k] = map_, np.unique(hashes)
        for batch in batches:
            for rows, text in slices(batch):
                words: Words = words_of(text, ALNUM)
                check = signed(run_hashes(text, text.offsets[:-1], text.offsets[1:], lower=False, seed=2))
                ids = rows.column("doc_id")
                empty = pa.nulls(len(rows), pa.int64())
                yield record(schema, doc_id=ids, check=check, n_words=words.count, at=empty, gram=pa.nulls(len(rows), pa.string()))
                hashes = word_hashes(text, words)
                for k, (map_, exact) in maps.items():
                    at, value = windows(hashes, words.owner, k)
                    hit = np.flatnonzero(map_[(value >> np.uint64(44)).astype(np.int64)])
                    hit = at[hit[np.isin(value[hit], exact)]]
                    owner = words.owner[hit]
                    grams = [b" ".join(text.data[a:b].tobytes() for a, b in zip(words.start[j : j + k], words.end[j : j + k])).lower().decode() for j in hit]
                    if len(hit):
                        yield record(
                            schema, doc_id=ids.take(pa.array(owner)), check=check[owner], n_words=words.count[owner], at=hit - words.first[owner], gram=grams
                        )

    return docs.mapInArrow(emit, "doc_id long, check long, n_words long, at long, gram string")


def license_spans(grams: DataFrame, templates: tuple[Template, ...], gap: int, cover: float) -> DataFrame:
    """(doc_id, check, template, label, base, start, end, coverage, found) of every merged span."""
    spark = grams.sparkSession
    table = spark.createDataFrame(template_table(templates), "template int, label string, base boolean, k int, size int, place int, gram string")
    votes = grams.join(F.broadcast(table), "gram")  # the templates are fixed: a few hundred rows
    doc = ["doc_id", "check"]
    diagonals = votes.groupBy(*doc, "template", "label", "base", "k", "size", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places")
    )
    order = W.partitionBy(*doc, "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("base"), 0).otherwise(gap), F.lit(True))
    merged = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    each = merged.select("*", F.explode("places").alias("place")).withColumn("at", F.col("diagonal") + F.col("place"))
    along = W.partitionBy(*doc, "template", "span").orderBy("at", "place").rowsBetween(W.unboundedPreceding, -1)
    rising = each.withColumn("before", F.max("place").over(along)).filter(F.col("before").isNull() | (F.col("place") > F.col("before")))
    span = rising.groupBy(*doc, "template", "label", "base", "k", "size", "span").agg(
        F.collect_list("place").alias("places"), F.min("at").alias("start"), F.max(F.col("at") + F.col("k")).alias("end")
    )
    must = spark.createDataFrame(telling(templates, cover), "template int, must array<array<int>>, must_runs array<array<int>>")
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    covered = span.withColumn("words", words).withColumn("coverage", F.round(F.size("words") / F.col("size"), 6)).join(F.broadcast(must), "template")
    told = F.forall("must", lambda m: F.arrays_overlap(m, F.col("words"))) & F.forall("must_runs", lambda m: F.arrays_overlap(m, F.col("places")))
    held = covered.withColumn("held", (F.col("coverage") >= F.when(F.col("base"), 1.0).otherwise(cover)) & told)
    notice = F.struct("start", "end", "label", F.struct("coverage", "size", (-F.col("template")).alias("first")).alias("worth"))
    rivals = F.collect_list(F.when(F.col("held") & ~F.col("base"), notice)).over(W.partitionBy(*doc))
    mine = F.struct("coverage", "size", (-F.col("template")).alias("first"))
    beaten = F.exists(rivals, lambda r: (r["start"] < F.col("end")) & (r["end"] > F.col("start")) & (r["label"] != F.col("label")) & (r["worth"] > mine))
    return held.withColumn("found", F.col("held") & (F.col("base") | ~beaten)).select(
        *doc, "template", "label", "base", "start", "end", F.when(F.col("found"), F.col("coverage")).alias("coverage"), "found"
    )


def license_scan(
    docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, gap: int = 6, cover: float = 0.7, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs`` with the base places, all labels, and the best coverage of what was found as score.

    Base phrases count at every place where all their words stand in a row. A notice is found where neighbouring
    diagonals (at most ``gap`` apart) cover at least ``cover`` of its words in order and all its telling ones. Null and empty texts have no words; repeated
    rows are judged alike and each kept, rows without an id are told apart by their text, an empty table gives an empty
    one, and other columns are not looked at.
    """
    grams = _grams(texts(docs, key, text), templates)
    spans = license_spans(grams.filter(F.col("gram").isNotNull()), templates, gap, cover)
    base = F.col("found") & F.col("base")
    heads = grams.filter(F.col("gram").isNull()).select("doc_id", "check", "n_words", F.lit(None).cast("boolean").alias("found"))
    parts = heads.unionByName(spans, allowMissingColumns=True)

    def listed(rows) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(rows, F.col("label")))), ",")

    judged = parts.groupBy("doc_id", "check").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("found").isNull()).alias("copies"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(base).alias("base_labels"), listed(F.col("found")).alias("labels"), F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
        F.count_if("found").alias("n_spans"),
    )
    each = judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.drop("check", "copies", "copy")


def _sql(templates: tuple[Template, ...] = PHRASES + NOTICES, gap: int = 6, cover: float = 0.7) -> str:
    rows = ", ".join(f"({t}, '{label}', {base}, {k}, {size}, {at}, '{gram}')" for t, label, base, k, size, at, gram in template_table(templates))
    needed = ", ".join(f"({t}, {must}::bigint[][], {runs}::bigint[][])" for t, must, runs in telling(templates, cover))
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
with grams(template, label, base, k, size, place, gram) as (values {rows}),
musts(template, must, must_runs) as (values {needed}),
worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') as w
  from documents),
runs as (
  select doc_id, k, i - 1 as spot, array_to_string(w[i:i + k - 1], ' ') as gram
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from worded, (values ({SHORT}), ({LONG})) as ks(k))),
votes as (select doc_id, template, label, base, k, size, spot, spot - place as diagonal, place from runs join grams using (k, gram)),
diagonals as (select distinct doc_id, template, base, diagonal from votes),
fresh as (
  select *, case when diagonal - lag(diagonal) over o > case when base then 0 else {gap} end is not false then 1 else 0 end as f
  from diagonals window o as (partition by doc_id, template order by diagonal)),
spans as (select *, sum(f) over (partition by doc_id, template order by diagonal) as span from fresh),
rising as (
  select v.*, span, max(place) over (partition by v.doc_id, v.template, span order by spot, place rows between unbounded preceding and 1 preceding) as before
  from votes v join spans s on v.doc_id = s.doc_id and v.template = s.template and v.diagonal = s.diagonal),
merged as (
  select doc_id, template, label, base, k, size, span, list(place) as places, min(spot) as start, max(spot + k) as stop
  from rising where before is null or place > before group by all),
covered as (
  select *, list_distinct(flatten(list_transform(places, lambda p: range(p, p + k)))) as words from merged),
held as (
  select *, round(len(words) / size, 6) as coverage,
         coverage >= case when base then 1.0 else {cover} end
         and len(list_filter(must, lambda m: not list_has_any(m, words))) = 0
         and len(list_filter(must_runs, lambda m: not list_has_any(m, places))) = 0 as held
  from covered join musts using (template)),
found as (
  select * from held h where held and (base or not exists (
    select 1 from held r where r.doc_id = h.doc_id and r.held and not r.base and r.label <> h.label and r.start < h.stop and r.stop > h.start
      and (r.coverage > h.coverage or (r.coverage = h.coverage and (r.size > h.size or (r.size = h.size and r.template < h.template)))))))
select d.doc_id, len(any_value(d.w))::bigint as n_words, count(*) filter (where base) as n_base,
       min(start) filter (where base) as first_word, max(start) filter (where base) as last_word,
       coalesce(array_to_string(list_sort(list(distinct label) filter (where base)), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list(distinct label) filter (where label is not null)), ','), '') as labels,
       coalesce(max(coverage), 0.0)::double as score, count(label) as n_spans
from worded d left join found f on d.doc_id = f.doc_id group by d.doc_id"""


@query(_sql())
def op1_license_scan(spark, folder):
    """Licence phrases and notices in all documents."""
    return license_scan(documents(spark, folder))
