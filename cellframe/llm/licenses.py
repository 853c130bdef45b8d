"""Licence recognition by sentences, in DataFrame expressions only.

A text is cut into sentences, each is normalised and mapped to the identifier of a
known licence sentence, and ordered rules are matched against the text's sequence of
identifiers. The first rule that matches blanks its identifiers, so that a later, more
general one cannot use them again, nor join what stands before them to what stands
behind. Identifiers that no rule takes are reported as
left over. The main path has no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import keyed_text

# Licence and the SPDX identifiers that name it.
SPDX = [
    ("Apache-2.0", "apache-2[.]0"),
    ("MIT", "mit"),
    ("GPL-2.0", "gpl-2[.]0(-only)?"),
    ("GPL-2.0-or-later", "gpl-2[.]0(-or-later|[+])"),
    ("GPL-3.0", "gpl-3[.]0(-only)?"),
    ("GPL-3.0-or-later", "gpl-3[.]0(-or-later|[+])"),
    ("AGPL-3.0", "agpl-3[.]0(-only)?"),
    ("AGPL-3.0-or-later", "agpl-3[.]0(-or-later|[+])"),
    ("LGPL-2.0", "lgpl-2[.]0(-only)?"),
    ("LGPL-2.0-or-later", "lgpl-2[.]0(-or-later|[+])"),
    ("LGPL-2.1", "lgpl-2[.]1(-only)?"),
    ("LGPL-2.1-or-later", "lgpl-2[.]1(-or-later|[+])"),
    ("LGPL-3.0", "lgpl-3[.]0(-only)?"),
    ("LGPL-3.0-or-later", "lgpl-3[.]0(-or-later|[+])"),
    ("BSD-2-Clause", "bsd-2-clause"),
    ("BSD-3-Clause", "bsd-3-clause"),
    ("ISC", "isc"),
    ("MPL-2.0", "mpl-2[.]0"),
    ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-4[.]0"),
    ("CC-BY-NC-4.0", "cc-by-nc-4[.]0"),
    ("CC-BY-SA-4.0", "cc-by-sa-4[.]0"),
    ("CC-BY-4.0", "cc-by-4[.]0"),
    ("CC0-1.0", "cc0-1[.]0"),
    ("Unlicense", "unlicense"),
    ("Zlib", "zlib"),
    ("BSL-1.0", "bsl-1[.]0"),
    ("0BSD", "0bsd"),
    ("EPL-2.0", "epl-2[.]0"),
    ("WTFPL", "wtfpl"),
]

# Identifier and pattern of a normalised licence sentence (lower case, one
# space between words, marks at the ends gone), in order; the first that matches counts.
# Sentences end at semicolons too: the GNU notices that have one there are two of them,
# Terms and Later. WRAPS leaves "spdx" of an SPDX tag; tags of several licences are SpdxTag.
SENTENCES = [
    ("Negated", "(.* )?(not|never|nor|isn't|aren't|no longer|cannot be) (be |been |yet |itself )?(licensed|released|dedicated|distributed|made available|available) (under|to) .*"),
    ("Negated", "(.* )?(nothing|none|no part|no files?)( .*)? (is|are|was|were) (licensed|released|dedicated|distributed|made available|available) (under|to) .*"),
    ("GplVersion3", "(.* )?(redistribute it and/or modify it|modify it|redistribute it) under the terms of the gnu general public license,? as published by the free software foundation[,;]? version 3( of the license)?,?( only)?"),
    ("GplVersion2", "(.* )?(redistribute it and/or modify it|modify it|redistribute it) under the terms of the gnu general public license,? as published by the free software foundation[,;]? version 2( of the license)?,?( only)?"),
    ("Agpl3", "(.* )?(redistribute it and/or modify it|modify it|redistribute it) under the terms of the gnu affero general public license,? as published by the free software foundation[,;]? version 3( of the license)?,?( only)?"),
    ("Gpl2OrLater", "(.* )?(redistribute it and|modify it under|under the terms of) .*gnu general public license.* either version 2([.]0)?[ ,].*or .*any later version.*"),
    ("Gpl3OrLater", "(.* )?(redistribute it and|modify it under|under the terms of) .*gnu general public license.* either version 3([.]0)?[ ,].*or .*any later version.*"),
    ("GplVersionOrLater", "(.* )?(redistribute it and|modify it under|under the terms of) .*gnu general public license.* either version [0-9.]+.*or .*any later version.*"),
    ("Gpl2OrLater", "(.* )?(licensed under|under the terms of|released under) the gnu general public license,? (v|version )2([.]0)?,? or .*(later|newer).*"),
    ("Gpl3OrLater", "(.* )?(licensed under|under the terms of|released under) the gnu general public license,? (v|version )3([.]0)?,? or .*(later|newer).*"),
    *[
        (f"Lgpl{name}{tail}", f"(.* )?(licensed under|under the terms of|released under) .*gnu (lesser|library) general public license,?( as published by the free software foundation)?[,;]? (either )?(v|version ){number}( of the license)?{later}.*")
        for name, number in (("21", "2[.]1"), ("2", "2([.]0)?"), ("3", "3([.]0)?"))
        for tail, later in (("OrLater", ",? or .*(later|newer)"), ("", "([ ,;(-]|$)"))
    ],
    ("LgplTerms", "(.* )?under the terms of the gnu (lesser|library) general public license( as published by the free software foundation)?"),
    ("Agpl3OrLater", "(.* )?(licensed under|under the terms of|released under) the gnu affero general public license,?( as published by the free software foundation,?)? (either )?(v|version )3([.]0)?( of the license)?,? or .*(later|newer).*"),
    ("Agpl3", "(.* )?(licensed under|under the terms of|released under) the gnu affero general public license,?( as published by the free software foundation,?)? (either )?(v|version )3.*"),
    ("AgplTerms", "(.* )?under the terms of the gnu affero general public license( as published by the free software foundation)?"),
    ("GplVersion3", "(.* )?(licensed under|under the terms of|released under) (the gnu general public license,? (v|version )3|version 3 of the gnu general public license).*"),
    ("GplVersion2", "(.* )?(licensed under|under the terms of|released under) (the gnu general public license,? (v|version )2|version 2 of the gnu general public license).*"),
    ("GplTerms", "(.* )?under the terms of the gnu general public license( as published by the free software foundation)?"),
    ("Later2", "either version 2([.]0)?( of the license)?,? or .*any later version.*"),
    ("Later21", "either version 2[.]1( of the license)?,? or .*any later version.*"),
    ("Later3", "either version 3([.]0)?( of the license)?,? or .*any later version.*"),
    ("Only2", "version 2([.]0)?( of the license)?,?( only)?"),
    ("Only21", "version 2[.]1( of the license)?,?( only)?"),
    ("Only3", "version 3([.]0)?( of the license)?,?( only)?"),
    *[
        (f"{kind}{number}{tail}" if tail or kind != "Gpl" else f"GplVersion{number}", f"(.* )?(licensed|released|distributed|available) under (the )?(terms of the )?(gnu )?{short} ?-?(v|v[.] ?|version )?{version}{later}")
        for kind, short in (("Agpl", "agpl"), ("Lgpl", "lgpl"), ("Gpl", "gpl"))
        for number, version in (("21", "2[.]1"), ("2", "2([.]0)?"), ("3", "3([.]0)?"))
        if (kind, number) not in (("Agpl", "21"), ("Agpl", "2"), ("Gpl", "21"))
        for tail, later in (("OrLater", "([+]|,? or .*(later|newer)|-or-later)( .*)?"), ("", "( only|-only)?( licen[cs]e)?([ ,;(].*)?"))
    ],
    ("GplNoWarranty", "(.* )?is distributed in the hope that it will be useful, but without any warranty.*"),
    ("GplSeeCopy", "you should have received a copy of the gnu (lesser |library |affero )?general public license along with .*"),
    ("ApacheGrant2", "(.* )?(licensed|released) under the apache license,? (version |v[.]?)?2([.]0)?([ ,;(-].*)?"),
    ("ApacheGrant2", "(.* )?(licensed|released|distributed|available) under (the )?(terms of the )?apache(-| software license |-license-| license )?,? ?(v|v[.] ?|version )?2([.]0)?( licen[cs]e)?([ ,;(-].*)?"),
    ("ApacheTitle", "(.* )?apache license,? version 2[.]0, january 2004( .*)?"),
    ("ApacheMayNotUse", "(.* )?you may not use this file except in compliance with the license"),
    ("ApacheObtainCopy", "(.* )?you may obtain a copy of the license at.*"),
    ("ApacheAsIs", "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis.*"),
    ("OtherLicensed", "(.* )?(licensed|released) under the (terms of the )?(mit|.*bsd) licen[cs]e.* (and|or) .*(gpl|gnu|apache|bsd|mit|mozilla|licen[cs]e).*"),
    ("MitReleased", "(.* )?(licensed|released) under the (terms of the )?mit licen[cs]e([ ,(-].*)?"),
    ("MitGrant", "(.* )?permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.*"),
    ("MitNotice", "the above copyright notice and this permission notice( [(]including the next paragraph[)])? shall be included in all copies or substantial portions of the software.*"),
    ("AsIsUpper", "the software is provided \"as is\", without warranty of any kind.*"),
    ("BsdGrant", "(.* )?redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BsdSource", "(.* )?redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.*"),
    ("BsdBinary", "(.* )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("BsdAdvertising", "(.* )?all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("BsdNoEndorse", "(.* )?((neither the name|nor the names) of .* may be used|the names? of .* may not be used) to endorse or promote products derived from this software without specific prior written permission.*"),
    ("BsdReleased", "(.* )?(licensed|released) under the (terms of the )?((3-clause|new|modified) bsd|bsd 3-clause) licen[cs]e([ ,(-].*)?"),
    ("Bsd2Released", "(.* )?(licensed|released) under the (terms of the )?((2-clause|simplified) bsd|bsd 2-clause) licen[cs]e([ ,(-].*)?"),
    ("Unlicense", "(.* )?this is free and unencumbered software released into the public domain.*"),
    ("UnlicenseAnyone", "(.* )?anyone is free to copy, modify, publish, use, compile, sell,? or distribute this software.*"),
    ("ZlibAsIs", "(.* )?this software is provided 'as-is', without any express or implied warranty.*"),
    ("ZlibGrant", "(.* )?permission is granted to anyone to use this software for any purpose, including commercial applications.*"),
    ("BoostGrant", "(.* )?permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("BoostReleased", "(.* )?(distributed|licensed|released) under the boost software license,? v(ersion )?1[.]0.*"),
    ("Epl2", "(.* )?(made available|licensed|released) under the (terms of the )?eclipse public license,?( -)?( v| v[.]| version)? ?2[.]0.*"),
    ("ZeroBsdGrant", "(.* )?permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("WtfplTerms", "(.* )?do what the f[a-z*]+ you want to public license.*"),
    ("IscGrant", "(.* )?permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted.*"),
    ("MplNotice", "(.* )?this source code form is subject to the terms of the mozilla public license,? (v|v[.]? ?2([.]0)?|version 2([.]0)?)"),
    ("Mpl11Notice", "(.* )?the contents of this file are subject to the mozilla public license,? (v[.]?|version) ?1[.]1([ ,;(-].*)?"),
    *[
        (name, f"(.* )?(licensed|released|available|distributed) under (a |the )?(terms of the )?(cc|creative commons) attribution{kind} 4([.]0)?( international)?( public)?( licen[cs]e)?([ ,;(-].*)?")
        for name, kind in (("CcByNcSa4", "[- ]noncommercial[- ]sharealike"), ("CcByNc4", "[- ]noncommercial"), ("CcBySa4", "[- ]sharealike"), ("CcBy4", ""))
    ],
    ("CcByNcSa4", "(.* )?(licensed|released) under (a |the )?(cc|creative commons) by-nc-sa 4([.]0)?([ ,;(-].*)?"),
    ("CcByNc4", "(.* )?(licensed|released) under (a |the )?(cc|creative commons) by-nc 4([.]0)?([ ,;(-].*)?"),
    ("CcBySa4", "(.* )?(licensed|released) under (a |the )?(cc|creative commons) by-sa 4([.]0)?([ ,;(-].*)?"),
    ("CcBy4", "(.* )?(licensed|released) under (a |the )?(cc|creative commons) by 4([.]0)?([ ,;(-].*)?"),
    ("Cc0Dedication", "(.* )?(cc0 1[.]0( universal)?|creative commons zero( v?1[.]0)?)([ ,;(-].*)?"),
    ("PublicDomain", "(.* )?(dedicated to|placed in|released into) the public domain.*"),
    ("SpdxTag", "(.* )?spdx [(]*[a-z0-9.+-]+ (or|and|with) .*"),
    *[("Spdx:" + name, f"(.* )?spdx ({tags})( .*)?") for name, tags in SPDX],
    ("SpdxTag", "(.* )?spdx .*"),
    ("CopyrightLine", "(copyright|©) .*[0-9]{4}.*"),
    ("AllRights", "all rights reserved"),
    ("OtherLicensed", "(.* )?(licensed|released) under .*"),
]

# Licence and the sequence of identifiers that shows it, the more specific
# rules first.
RULES = [
    ("Apache-2.0", ["ApacheGrant2", "ApacheMayNotUse", "ApacheObtainCopy", "ApacheAsIs"]),
    ("Apache-2.0", ["ApacheGrant2", "ApacheMayNotUse"]),
    ("Apache-2.0", ["ApacheGrant2"]),
    ("Apache-2.0", ["ApacheTitle"]),
    *[
        (name, ids + tail)
        for tail in (["GplNoWarranty", "GplSeeCopy"], ["GplNoWarranty"], [])
        for name, ids in [
            ("GPL-2.0-or-later", ["Gpl2OrLater"]),
            ("GPL-2.0-or-later", ["GplTerms", "Later2"]),
            ("GPL-3.0-or-later", ["Gpl3OrLater"]),
            ("GPL-3.0-or-later", ["GplTerms", "Later3"]),
            ("AGPL-3.0-or-later", ["Agpl3OrLater"]),
            ("AGPL-3.0-or-later", ["AgplTerms", "Later3"]),
            ("AGPL-3.0", ["Agpl3"]),
            ("LGPL-2.0-or-later", ["Lgpl2OrLater"]),
            ("LGPL-2.0-or-later", ["LgplTerms", "Later2"]),
            ("LGPL-2.0", ["Lgpl2"]),
            ("LGPL-2.1-or-later", ["Lgpl21OrLater"]),
            ("LGPL-2.1-or-later", ["LgplTerms", "Later21"]),
            ("LGPL-2.1", ["Lgpl21"]),
            ("LGPL-3.0-or-later", ["Lgpl3OrLater"]),
            ("LGPL-3.0-or-later", ["LgplTerms", "Later3"]),
            ("LGPL-3.0", ["Lgpl3"]),
            ("LGPL-2.0", ["LgplTerms", "Only2"]),
            ("LGPL-2.1", ["LgplTerms", "Only21"]),
            ("LGPL-3.0", ["LgplTerms", "Only3"]),
            ("AGPL-3.0", ["AgplTerms", "Only3"]),
            ("GPL-2.0", ["GplTerms", "Only2"]),
            ("GPL-3.0", ["GplTerms", "Only3"]),
            ("GPL-3.0", ["GplVersion3"]),
            ("GPL-2.0", ["GplVersion2"]),
        ]
    ],
    ("MIT", ["MitGrant", "MitNotice", "AsIsUpper"]),
    ("MIT", ["MitReleased"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdNoEndorse"]),
    ("BSD-4-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("BSD-3-Clause", ["BsdReleased"]),
    ("BSD-2-Clause", ["Bsd2Released"]),
    ("0BSD", ["ZeroBsdGrant"]),
    ("ISC", ["IscGrant"]),
    ("Unlicense", ["Unlicense", "UnlicenseAnyone"]),
    ("Unlicense", ["Unlicense"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("BSL-1.0", ["BoostGrant"]),
    ("BSL-1.0", ["BoostReleased"]),
    ("EPL-2.0", ["Epl2"]),
    ("WTFPL", ["WtfplTerms"]),
    ("MPL-2.0", ["MplNotice"]),
    ("MPL-1.1", ["Mpl11Notice"]),
    ("CC-BY-NC-SA-4.0", ["CcByNcSa4"]),
    ("CC-BY-NC-4.0", ["CcByNc4"]),
    ("CC-BY-SA-4.0", ["CcBySa4"]),
    ("CC-BY-4.0", ["CcBy4"]),
    ("CC0-1.0", ["Cc0Dedication"]),
    *[(name, ["Spdx:" + name]) for name, _ in SPDX],
]

#: A sentence that holds none of these cannot be a known one; the check is cheap.
HINTS = ("licen", "copyright", "©", "permi", "warranty", "redistribut", "all rights", "endorse", "copy of the", "public domain", "cc0", "applicable law", "spdx", "any later version", "in the hope", "under the gpl", "under gpl", "under lgpl", "under the lgpl", "under agpl", "under the agpl", "under the gnu", "under apache", "under the apache", "under cc", "creative commons", "advertising materials", "version 2", "version 3", "as-is", "anyone is free")
SPLIT = r"\n[ \t\r\f\x0B]*\n|[.!?;:](?:[ \t\r\n\f\x0B]|$)"
#: Line ends with the comment signs that start the next line; the rest of an SPDX tag, whose colon ends no sentence.
WRAPS = r"\n[ \t]*(?:#+|\*+|//+|;+|--)[ \t]*|-license-identifier:[ \t]*"
ENDS = " \t.,;:!?*/#()<>|-"
SPACES = r"[ \t\r\n\f\x0B]+"


def identifier(sentence: Column) -> Column:
    """The identifier of a normalised sentence, null if it is not a known one."""
    case = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in SENTENCES:
        case = case.when(sentence.rlike(f"^(?:{pattern})$"), F.lit(name))
    return case


def sentences(lowered: Column) -> Column:
    """Normalised sentences of a lower-case text that may be a licence's."""
    hinted = lambda s: F.exists(F.array(*map(F.lit, HINTS)), lambda h: F.contains(s, h))
    cut = F.split(F.regexp_replace(lowered, WRAPS, "\n"), SPLIT)
    return F.transform(F.filter(cut, hinted), lambda s: F.btrim(F.regexp_replace(s, SPACES, " "), F.lit(ENDS)))


def recognise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licenses, n_left) for every row.

    ``sentence_ids`` are the identifiers in text order and ``licenses`` the licences in
    rule order, each once, both comma-joined; ``n_left`` counts identifiers that no rule
    took. Null and empty texts have none of either. Repeated rows and null ids stay;
    other columns are left out; texts are read whole.
    """
    likely = F.lit(False)
    for hint in HINTS:
        likely = likely | F.contains("lowered", F.lit(hint))
    none = F.array().cast("array<string>")
    known = F.when(likely, F.filter(F.transform(sentences(F.col("lowered")), identifier), lambda i: i.isNotNull())).otherwise(none)
    lowered = keyed_text(docs, id_col, text_col).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("lowered"))
    rows = lowered.select("doc_id", known.alias("ids"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(ids) + ",").alias("form")) for name, ids in RULES])
    start = F.struct(F.concat_ws("", F.transform("ids", lambda i: F.concat(F.lit(","), i, F.lit(",")))).alias("rest"), none.alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        met = F.contains(state["rest"], rule["form"])
        rest = F.when(met, F.replace(state["rest"], rule["form"], F.lit("_"))).otherwise(state["rest"])
        names = F.when(met & ~F.array_contains(state["names"], rule["name"]), F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(rest.alias("rest"), names.alias("names"))

    end = F.when(F.size("ids") > 0, F.aggregate(rules, start, apply)).otherwise(start)
    left = ((F.length("end.rest") - F.length(F.replace(F.col("end.rest"), F.lit(","), F.lit("")))) / 2).cast("long")
    return rows.select("doc_id", "ids", end.alias("end")).select("doc_id", F.concat_ws(",", "ids").alias("sentence_ids"), F.concat_ws(",", "end.names").alias("licenses"), left.alias("n_left"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    hints = ", ".join(map(quoted, HINTS))
    case = " ".join(f"WHEN regexp_full_match(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES)
    steps, last = [], "start"
    for k, (name, ids) in enumerate(RULES):
        form = quoted("," + ",,".join(ids) + ",")
        met = f"contains(rest, {form})"
        steps.append(f"r{k} AS (SELECT doc_id, ids, CASE WHEN {met} THEN replace(rest, {form}, '_') ELSE rest END AS rest, CASE WHEN {met} AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END AS names FROM {last})")
        last = f"r{k}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), {quoted(WRAPS)}, chr(10), 'g'), {quoted(SPLIT)}),
    lambda s: len(list_filter([{hints}], lambda h: contains(s, h))) > 0),
    lambda s: trim(regexp_replace(s, {quoted(SPACES)}, ' ', 'g'), {quoted(ENDS)})) AS parts FROM documents),
start AS (
  SELECT doc_id, ids, array_to_string(list_transform(ids, lambda i: ',' || i || ','), '') AS rest, CAST([] AS VARCHAR[]) AS names
  FROM (SELECT doc_id, list_filter(list_transform(parts, lambda s: CASE {case} END), lambda i: i IS NOT NULL) AS ids FROM cut)),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(names, ',') AS licenses,
  CAST((length(rest) - length(replace(rest, ',', ''))) // 2 AS BIGINT) AS n_left
FROM {last}"""
