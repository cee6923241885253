"""License scans: hundreds of signature rules behind a keyword prefilter, with priority and containment.

Only DataFrame functions. A text is lower-cased (A-Z) and cut into words; rules are regular expressions over the words
joined by single spaces. Each rule names a word that any match of it holds: a text's words select the rules to try by a
hash join, so that a text without such words is never searched. Of overlapping detections those go that lie inside one
of the same or a higher priority. Base phrases are counted at every place and are never suppressed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Phrases whose every place counts, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Priorities, the highest first, and what a detection of each says about a licence (0 to 1).
SPDX, NOTICE, URL, NAME, HINT = range(5)
WEIGHT = {SPDX: 1.0, NOTICE: 0.95, URL: 0.9, NAME: 0.8, HINT: 0.4}

#: Identifiers that a tag may give, by the public list; a tag's rule follows from the identifier.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 Beerware
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1
bzip2-1.0.6 CAL-1.0 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0
CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5
CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0
Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0
ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 Libpng LPL-1.02 LPPL-1.3c MirOS MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL
MulanPSL-2.0 NCSA NTP ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL PSF-2.0
QPL-1.0 Ruby SISSL SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1
"""

#: label | priority | a word that every match holds | pattern over words joined by spaces. The order breaks ties.
RULES = """
apache-2.0 | NOTICE | apache | licensed under (?:the )?apache license,? (?:version|v) ?2(?: 0)?
apache-2.0 | NOTICE | apache | apache license version 2(?: 0)?(?: january 2004)?
apache-2.0 | URL | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2.0 | NAME | apache | apache (?:software )?(?:license )?v?2(?: 0)?
apache-1.1 | NAME | apache | apache (?:software )?license (?:version )?1 1
apache-1.0 | NAME | apache | apache (?:software )?license (?:version )?1 0
apache | HINT | apache | apache licen[sc]ed?
mit | NOTICE | license | (?:released|licensed|distributed|available|published) under the (?:terms of the )?mit license
mit | NOTICE | charge | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | NOTICE | warranty | the software is provided as is without warranty of any kind express or implied
mit | URL | opensource | opensource org licenses? mit(?: license)?
mit | NAME | license | (?:the )?mit license
mit | NAME | licence | (?:the )?mit licence
mit | NAME | expat | expat license
mit-0 | NAME | attribution | mit no attribution
x11 | NAME | x11 | x11 license
bsd-2-clause | NAME | bsd | (?:simplified|freebsd|2 clause|two clause) bsd license
bsd-2-clause | NAME | bsd | bsd 2 clause(?: license)?
bsd-3-clause | NAME | bsd | (?:new|revised|modified|3 clause|three clause) bsd license
bsd-3-clause | NAME | bsd | bsd 3 clause(?: license)?
bsd-4-clause | NAME | bsd | (?:original|old|4 clause|four clause) bsd license
bsd-4-clause | NOTICE | advertising | all advertising materials mentioning features or use of this software
bsd-3-clause | NOTICE | endorse | may be used to endorse or promote products derived from this software
bsd | NOTICE | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | URL | opensource | opensource org licenses? bsd(?: license)?
bsd-2-clause | URL | opensource | opensource org licenses? bsd 2 clause
bsd-3-clause | URL | opensource | opensource org licenses? bsd 3 clause
bsd | NAME | bsd | bsd (?:style )?licen[sc]ed?
isc | NOTICE | fee | permission to use copy modify and or distribute this software for any purpose with or without fee
isc | NAME | isc | isc licen[sc]ed?
isc | URL | opensource | opensource org licenses? isc
gpl-1.0 | NAME | gpl | gpl (?:version |v)?1(?: 0)?
gpl-2.0 | NOTICE | general | (?:gnu )?general public license,? (?:version|v) ?2(?: 0)?
gpl-2.0 | NAME | gpl | (?:gnu )?gpl (?:version |v ?)?2(?: 0)?
gpl-2.0 | NAME | gplv2 | gplv2
gpl-2.0 | URL | gnu | gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 | NOTICE | general | (?:gnu )?general public license,? (?:version|v) ?3(?: 0)?
gpl-3.0 | NAME | gpl | (?:gnu )?gpl (?:version |v ?)?3(?: 0)?
gpl-3.0 | NAME | gplv3 | gplv3
gpl-3.0 | URL | gnu | gnu org licenses gpl(?: 3 0)?
gpl | NOTICE | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
gpl | NAME | general | (?:gnu )?general public licen[sc]e
lgpl-2.1 | NOTICE | lesser | (?:gnu )?lesser general public license,? (?:version|v) ?2 1
lgpl-3.0 | NOTICE | lesser | (?:gnu )?lesser general public license,? (?:version|v) ?3(?: 0)?
lgpl | NAME | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl | NAME | library | gnu library general public licen[sc]e
lgpl-2.1 | NAME | lgpl | lgpl (?:version |v ?)?2 1
lgpl-3.0 | NAME | lgpl | lgpl (?:version |v ?)?3(?: 0)?
lgpl | HINT | lgpl | lgpl
lgpl | URL | gnu | gnu org licenses (?:old licenses )?lgpl
agpl-3.0 | NOTICE | affero | (?:gnu )?affero general public license,? (?:version|v) ?3(?: 0)?
agpl | NAME | affero | (?:gnu )?affero general public licen[sc]e
agpl-3.0 | NAME | agpl | agpl (?:version |v ?)?3(?: 0)?
agpl | HINT | agpl | agpl
agpl-3.0 | URL | gnu | gnu org licenses agpl
gfdl | NAME | documentation | gnu free documentation licen[sc]e
gfdl | URL | gnu | gnu org licenses fdl
gpl | HINT | gpl | gpl
mpl-2.0 | NOTICE | mozilla | mozilla public license,? (?:version|v) ?2(?: 0)?
mpl-1.1 | NOTICE | mozilla | mozilla public license,? (?:version|v) ?1 1
mpl-1.0 | NOTICE | mozilla | mozilla public license,? (?:version|v) ?1 0
mpl-2.0 | NAME | mpl | mpl (?:version |v ?)?2(?: 0)?
mpl-1.1 | NAME | mpl | mpl (?:version |v ?)?1 1
mpl-2.0 | URL | mozilla | mozilla org mpl 2 0
mpl | NAME | mozilla | mozilla public licen[sc]e
epl-1.0 | NOTICE | eclipse | eclipse public license,? (?:version |v ?)?1 0
epl-2.0 | NOTICE | eclipse | eclipse public license,? (?:version |v ?)?2 0
epl | NAME | eclipse | eclipse public licen[sc]e
epl-1.0 | URL | eclipse | eclipse org legal epl v10
epl-2.0 | URL | eclipse | eclipse org legal epl (?:v20|2 0)
edl-1.0 | NAME | eclipse | eclipse distribution license
cddl-1.0 | NAME | cddl | (?:cddl) (?:version |v ?)?1 0
cddl-1.1 | NAME | cddl | (?:cddl) (?:version |v ?)?1 1
cddl | NAME | development | common development and distribution license
cpl-1.0 | NAME | common | common public license(?: version 1 0)?
cpal-1.0 | NAME | attribution | common public attribution license
ipl-1.0 | NAME | ibm | ibm public license
eupl-1.1 | NAME | eupl | eupl (?:version |v ?)?1 1
eupl-1.2 | NAME | eupl | eupl (?:version |v ?)?1 2
eupl | NAME | european | european union public licen[sc]e
cc-by-4.0 | NOTICE | cc | licensed under (?:a )?cc by 4 0
cc-by-3.0 | NOTICE | cc | licensed under (?:a )?cc by 3 0
cc-by-sa-4.0 | NOTICE | cc | licensed under (?:a )?cc by sa 4 0
cc-by-sa-3.0 | NOTICE | cc | licensed under (?:a )?cc by sa 3 0
cc-by-nc-4.0 | NOTICE | cc | licensed under (?:a )?cc by nc 4 0
cc-by-nc-3.0 | NOTICE | cc | licensed under (?:a )?cc by nc 3 0
cc-by-nc-sa-4.0 | NOTICE | cc | licensed under (?:a )?cc by nc sa 4 0
cc-by-nc-nd-4.0 | NOTICE | cc | licensed under (?:a )?cc by nc nd 4 0
cc-by-nd-4.0 | NOTICE | cc | licensed under (?:a )?cc by nd 4 0
cc-by-nc-sa | NAME | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd | NAME | cc | cc by nc nd(?: [1-4] [05])?
cc-by-nc | NAME | cc | cc by nc(?: [1-4] [05])?
cc-by-nd | NAME | cc | cc by nd(?: [1-4] [05])?
cc-by-sa | NAME | cc | cc by sa(?: [1-4] [05])?
cc-by | HINT | cc | cc by(?: [1-4] [05])?
cc0-1.0 | NAME | cc0 | cc0(?: 1 0)?
cc0-1.0 | URL | creativecommons | creativecommons org publicdomain zero 1 0
cc-pd | URL | creativecommons | creativecommons org publicdomain mark 1 0
cc-by | URL | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | URL | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nc | URL | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | URL | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc-sa | URL | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | URL | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc-by | NAME | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?
cc-by-sa | NAME | creative | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-nc | NAME | creative | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | NAME | creative | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?
cc-by-nc-sa | NAME | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | NAME | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?
cc0-1.0 | NAME | creative | creative commons zero
cc | HINT | creative | creative commons
public-domain | NOTICE | domain | (?:released|placed|dedicated) (?:in)?to the public domain
public-domain | NOTICE | domain | this (?:work|file|code|software|text) is in the public domain
public-domain | HINT | domain | public domain
unlicense | NAME | unlicense | (?:the )?unlicense
unlicense | NOTICE | unencumbered | this is free and unencumbered software released into the public domain
unlicense | URL | unlicense | unlicense org
wtfpl | NAME | wtfpl | wtfpl
wtfpl | NAME | fuck | do what the fuck you want to public license
zlib | NAME | zlib | zlib(?: libpng)? licen[sc]e
zlib | NOTICE | altered | altered source versions must be plainly marked as such
libpng | NAME | libpng | libpng licen[sc]e
bsl-1.0 | NAME | boost | boost software license(?: version 1 0)?
bsl-1.0 | URL | boost | boost org license 1 0
busl-1.1 | NAME | business | business source license(?: 1 1)?
sspl-1.0 | NAME | server | server side public license
elastic-2.0 | NAME | elastic | elastic license(?: v?2(?: 0)?)?
artistic-2.0 | NAME | artistic | artistic license (?:version )?2(?: 0)?
artistic-1.0 | NAME | artistic | artistic license (?:version )?1(?: 0)?
artistic | NAME | artistic | artistic licen[sc]e
perl | NOTICE | perl | under the same terms as perl(?: itself)?
ruby | NAME | ruby | ruby licen[sc]e
psf-2.0 | NAME | python | python software foundation licen[sc]e
psf-2.0 | NAME | psf | psf licen[sc]e(?: version 2)?
php-3.01 | NAME | php | php licen[sc]e(?: version 3(?: 0)?1?)?
postgresql | NAME | postgresql | postgresql licen[sc]e
openssl | NAME | openssl | openssl licen[sc]e
openssl | NOTICE | openssl | this product includes software developed by the openssl project
w3c | NAME | w3c | w3c (?:software )?(?:notice and )?licen[sc]e
ofl-1.1 | NAME | sil | sil open font licen[sc]e(?: version 1 1)?
ofl-1.1 | NAME | ofl | ofl (?:version )?1 1
odbl-1.0 | NAME | database | open (?:data commons open )?database licen[sc]e
odc-by-1.0 | NAME | commons | open data commons attribution licen[sc]e
pddl-1.0 | NAME | commons | open data commons public domain dedication
ms-pl | NAME | microsoft | microsoft public licen[sc]e
ms-rl | NAME | microsoft | microsoft reciprocal licen[sc]e
afl-3.0 | NAME | academic | academic free licen[sc]e(?: version 3 0)?
osl-3.0 | NAME | osl | osl (?:version |v)?3 0
osl | NAME | open | open software license(?: version [123] [01])?
apsl-2.0 | NAME | apple | apple public source licen[sc]e
ncsa | NAME | ncsa | (?:university of illinois )?ncsa open source licen[sc]e
upl-1.0 | NAME | permissive | universal permissive licen[sc]e
qpl-1.0 | NAME | q | q public licen[sc]e
lppl-1.3c | NAME | latex | latex project public licen[sc]e
vim | NAME | vim | vim licen[sc]e
ijg | NAME | jpeg | independent jpeg group licen[sc]e
ftl | NAME | freetype | freetype (?:project )?licen[sc]e
icu | NAME | icu | icu licen[sc]e
unicode-dfs-2016 | NAME | unicode | unicode (?:inc )?license agreement
beerware | NAME | beerware | beerware licen[sc]e
beerware | NOTICE | beer | you can buy me a beer in return
json | NOTICE | evil | the software shall be used for good not evil
mulanpsl-2.0 | NAME | mulan | mulan psl v2
openrail | NAME | openrail | (?:creativeml )?openrail(?: m)?
openrail | NAME | rail | (?:creativeml )?open rail(?: m)?
llama | NAME | community | llama [0-9](?: [0-9])? community license
gemma | NAME | gemma | gemma terms of use
ai2-impact | NAME | impact | ai2 impact licen[sc]e
reserved | NOTICE | reserved | copyright (?:c )?(?:[0-9]{4} )?.{0,60}?all rights reserved
reserved | NAME | reserved | all rights reserved
copyright | HINT | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
proprietary | NOTICE | proprietary | (?:confidential and )?proprietary(?: and confidential)?
proprietary | NOTICE | unauthorized | unauthorized (?:copying|use|distribution|reproduction)
proprietary | NOTICE | unauthorised | unauthorised (?:copying|use|distribution|reproduction)
proprietary | NOTICE | permission | (?:without|no) (?:the )?(?:prior |express )?(?:written )?permission of
eula | NAME | user | end user license agreement
eula | NAME | eula | eula
commercial | NAME | commercial | commercial licen[sc]e
non-commercial | NOTICE | commercial | (?:for )?non commercial (?:use|purposes) only
non-commercial | NOTICE | noncommercial | (?:for )?noncommercial (?:use|purposes) only
research | NOTICE | research | for research (?:use|purposes) only
dual | NOTICE | dual | dual licen[sc]ed
"""


def rules() -> list[tuple[int, str, int, str, str]]:
    """Number, label, priority, keyword and pattern of each rule."""
    out = []
    for name in IDENTIFIERS.split():
        words = " ".join(w for w in "".join(c if c.isalnum() else " " for c in name.lower()).split())
        out.append((name.lower(), SPDX, "spdx", rf"spdx license identifier {words}(?: (?:only|or later))?"))
        out.append((name.lower(), SPDX, "identifier", rf"(?<!spdx )license identifier {words}(?: (?:only|or later))?"))
    levels = {"NOTICE": NOTICE, "URL": URL, "NAME": NAME, "HINT": HINT}
    for line in RULES.strip().splitlines():
        label, level, keyword, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((label, levels[level], keyword, pattern))
    return [(k, label, level, keyword, rf"\b(?:{pattern})\b") for k, (label, level, keyword, pattern) in enumerate(out)]


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rules(), "rule int, label string, level int, keyword string, pattern string")


def _places(words: Column, phrase: str) -> Column:
    """Word positions at which the phrase's words stand consecutively."""
    first, *rest = phrase.split()
    at = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    for k, w in enumerate(rest, 1):
        at = F.filter(at, _followed(words, k, w))
    return F.when(F.array_contains(words, first), at).otherwise(F.array().cast("array<int>"))


def _followed(words: Column, k: int, w: str) -> Callable[[Column], Column]:
    return lambda i: F.coalesce(F.get(words, i + k) == w, F.lit(False))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: DataFrame | None = None) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, detections for each text.

    detections are what remains after suppression: structs of begin and end (characters of the joined words), level,
    rule and label. score is the weight of the best one, 0 without any. A null or empty text has no words, labels are
    then empty texts and first_word and last_word null. Rows keep their number; ids may repeat or be null; docs may
    have any other columns. Rules (their number is bounded: they stand in this module) are broadcast.
    """
    table = rule_table(docs.sparkSession) if table is None else table
    keywords = sorted(r["keyword"] for r in table.select("keyword").distinct().collect())
    docs = C.spread(docs)
    base = docs.select(docs[id_col].alias("k0"), C.words_of(docs[text_col].cast("string")).alias("words"))
    firsts = sorted({p.split()[0] for p, _ in BASE})
    seen = F.array_distinct(F.filter("words", lambda w: w.isin([*keywords, *firsts])))
    own = [_places(F.col("words"), p) for p, _ in BASE]
    base = base.select("k0", F.size("words").cast("long").alias("n_words"), seen.alias("seen"), "words", F.monotonically_increasing_id().alias("row"))
    base = base.withColumns({"keys": F.filter("seen", lambda w: w.isin(keywords)), "based": F.exists("seen", lambda w: w.isin(firsts))})
    none = F.array().cast("array<int>")
    some = F.size("keys") > 0
    base = base.select("row", "k0", "n_words", "keys", F.when(some, F.concat_ws(" ", "words")).alias("joined"), *(F.when(F.col("based"), p).otherwise(none).alias(f"p{k}") for k, p in enumerate(own)))
    at = F.array_sort(F.concat(*(f"p{k}" for k in range(len(own)))))
    labels = F.array_sort(F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))), lambda x: x.isNotNull()))
    base = base.select("row", "k0", "n_words", "keys", "joined", F.size(at).cast("long").alias("n_base"), F.get(at, F.lit(0)).cast("long").alias("first_word"), F.when(F.size(at) > 0, F.element_at(at, -1)).cast("long").alias("last_word"), labels.alias("base"))
    columns = ["row", "k0", "n_words", "n_base", "first_word", "last_word", "base"]
    each = base.select(*columns, "joined", F.explode_outer("keys").alias("keyword"))
    tried = each.join(F.broadcast(table), "keyword", "left")
    tried = tried.withColumn("gaps", F.when(F.col("pattern").isNotNull(), F.split("joined", F.col("pattern")))).withColumn("found", F.when(F.size("gaps") > 1, F.regexp_extract_all("joined", F.col("pattern"), F.lit(0))))
    pairs = F.filter(F.arrays_zip("gaps", "found"), lambda p: p["found"].isNotNull())  # the last gap is before none
    lengths = F.transform(pairs, lambda p: F.struct(F.length(p["gaps"]).alias("gap"), F.length(p["found"]).alias("n")))
    hit = tried.select(*columns, "keyword", "rule", "label", "level", F.posexplode_outer(lengths).alias("nth", "p")).repartition("row")
    # a hit stands behind the gap before it and all before that
    so_far = Window.partitionBy("row", "keyword", "rule").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("end", F.sum(F.col("p.gap") + F.col("p.n")).over(so_far).cast("int"))
    hit = hit.select(*columns, "rule", "label", "level", (F.col("end") - F.col("p.n")).alias("begin"), "end")
    order = Window.partitionBy("row").orderBy("begin", F.col("end").desc_nulls_last(), "level", "rule").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted(WEIGHT)
    far = [F.max(F.when(F.col("level") == k, F.col("end"))).over(order).alias(f"far{k}") for k in levels]
    inside = F.lit(False)
    for k in levels:
        inside = inside | ((F.col("level") >= k) & F.coalesce(F.col(f"far{k}") >= F.col("end"), F.lit(False)))
    kept = hit.select("*", *far).withColumn("d", F.when(F.col("begin").isNotNull() & ~inside, F.struct("begin", "end", "level", "rule", "label")))
    out = kept.groupBy(*columns).agg(F.array_sort(F.collect_list("d")).alias("detections"))
    weight = F.lit(0.0)
    for k in reversed(levels):
        weight = F.when(F.exists("detections", _of_level(k)), F.lit(WEIGHT[k])).otherwise(weight)
    all_labels = F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    weight = F.greatest(weight, F.when(F.col("n_base") > 0, F.lit(WEIGHT[HINT])).otherwise(0.0))
    return out.select(F.col("k0").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"), weight.alias("score"), "detections")


def _of_level(k: int) -> Callable[[Column], Column]:
    return lambda d: d["level"] == k
