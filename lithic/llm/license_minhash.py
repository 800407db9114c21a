"""License scans: MinHash bands over text windows, then exact containment.

Texts are lower-cased runs of letters and digits.  Overlapping
windows of words (the next starts half a window on, so a passage of half a
window lies whole in one) are taken for each class of template lengths.  A
window's shingles of five words are hashed once and dealt to ``BINS`` bins by
their top bits; the least hash of a bin is that bin's MinHash, and each bin is a
band of one row.  A window retrieves the templates with which it shares a band.

Why bands of one row: a template of s shingles of which 80 % occur in a window
of at most 4s+8 shingles shares at least 0.8s of them, and a shared shingle
misses a band only if another one of the window or template lies lower in its
bin.  With 128 bins and s = 8 all shared shingles miss with a probability under
1e-4; the more shingles, the less.  Single-shingle templates in windows of 12
shingles are found with probability above 0.9 by one bin, so windows of the
shortest class use 4096 bins, where it is above 0.997.

Retrieved windows are verified: the share of the template's distinct shingles
that the window holds must reach ``CONTAINMENT``.  Only DataFrame functions.

Every text is split and hashed once for all classes; a text without any band key of a
class makes no windows for it.  Templates are a bounded table that becomes constants of
the query, so there is no join and no shuffle, and each row is reported by itself.

Defined results: null, empty and word-free texts match nothing; texts of fewer
than five words are one shingle; a license is reported once a row, with its largest
containment and first word there; rows that repeat an id or have none are reported each,
under their id; texts of any length are scanned whole; an empty table gives an empty
table; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_TERMS = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
#: The usual short notices of common licenses, their texts where these are short, and the notices that longer ones ask for.
TEMPLATES = {
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD_TERMS + " " + _BSD_END,
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: " + _BSD_TERMS + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY,
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-notice": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
SHINGLE, CONTAINMENT = 5, 0.8
#: Largest template words of a class, to bits of its bins.
CLASSES = {8: 12, 32: 7, 128: 7, 512: 7, 2048: 7}


def words(text: str) -> str:
    """SQL: lower-cased runs of letters and digits."""
    return rf"array_remove(split(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), '')"


def shingles(ws: str, size: int = SHINGLE) -> str:
    """SQL: hash of each run of words; of all words where there are fewer."""
    return f"""case when size({ws}) = 0 then cast(array() as array<bigint>)
      else transform(sequence(1, greatest(1, size({ws}) - {size - 1})), i -> xxhash64(slice({ws}, i, {size}))) end"""


def band_keys(hashes: str, bits: int) -> str:
    """SQL: the least hash of every bin that isn't empty."""
    low = f"sort_array({hashes})"
    return f"element_at(transform(array({low}), o -> filter(o, (x, i) -> i = 0 or shiftright(x, {64 - bits}) <> shiftright(element_at(o, greatest(i, 1)), {64 - bits}))), 1)"


def _longs(values) -> str:
    """SQL: an array of 64-bit numbers."""
    return "array(" + ",".join(f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)" for x in values) + ")"


def _name(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", key: str = "doc_id", containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, first_word`` for each license found in a row."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(list(templates.items()) or [("", "")], "license string, t string").where("t <> ''")
    known = known.select("license", F.expr(words("t")).alias("ws")).select("license", F.size("ws").alias("n"), F.expr(f"array_distinct({shingles('ws')})").alias("sh")).where("n > 0")
    bands = known.select("license", "n", "sh", *(F.expr(band_keys("sh", b)).alias(f"b{b}") for b in sorted(set(CLASSES.values()))))
    rows = bands.collect()  # as many as there are templates
    windows, tables, below = [], [], 0
    for most, bits in CLASSES.items():
        mine = [r for r in rows if below < r.n <= most or (most == max(CLASSES) and r.n > most)]
        below = most
        if not mine:
            continue
        span = max(2 * most, 2 * max(r.n for r in mine))
        step, held = span // 2, span - SHINGLE + 1
        keys = _longs(sorted({b for r in mine for b in r[f"b{bits}"]}))
        cut = f"""transform(sequence(0, greatest(0, cast(ceil((size(sh) - {held}) / {step}.0D) as int))),
              k -> named_struct('class', {len(tables)}, 'at', k * {step}, 'sh', slice(sh, 1 + k * {step}, {held})))"""
        # a window shares a band only if it holds a template's key, so a text without any makes none
        cut = f"filter(transform(filter({cut}, w -> arrays_overlap(w.sh, {keys})), w -> named_struct('class', w.class, 'at', w.at, 'sh', w.sh, 'met', array_intersect({band_keys('w.sh', bits)}, {keys}))), w -> size(w.met) > 0)"
        windows.append(f"if(arrays_overlap(sh, {keys}), {cut}, cast(array() as array<struct<class:int,at:int,sh:array<bigint>,met:array<bigint>>>))")
        tables.append(",".join(f"named_struct('license', {_name(r.license)}, 'wanted', {_longs(r.sh)}, 'bands', {_longs(r[f'b{bits}'])})" for r in mine))
    if not tables:
        return spark.createDataFrame([], "doc_id bigint, license string, containment double, first_word int")
    # explode(array(x)) keeps the optimizer from writing x out again at each use
    base = docs.selectExpr(f"cast(`{key}` as bigint) as doc_id", f"explode(array({words(f'`{text}`')})) as ws").selectExpr("doc_id", f"explode(array({shingles('ws')})) as sh")
    base = base.selectExpr("doc_id", f"explode(array(concat({', '.join(windows)}))) as ws").where("size(ws) > 0")
    # each window against the templates of its class with which it shares a band
    common = "array_intersect(t.wanted, w.sh)"
    found = f"""named_struct('license', t.license, 'c', size({common}) / cast(size(t.wanted) as double),
      'at', w.at + array_min(transform({common}, x -> cast(array_position(w.sh, x) as int))) - 1)"""
    table = f"element_at(array({', '.join(f'array({t})' for t in tables)}), w.class + 1)"
    hits = f"filter(flatten(transform(ws, w -> transform(filter({table}, t -> arrays_overlap(t.bands, w.met)), t -> {found}))), h -> h.c >= {containment}D)"
    base = base.selectExpr("doc_id", f"explode(array({hits})) as hs").where("size(hs) > 0")
    each = "transform(array_distinct(transform(hs, h -> h.license)), l -> named_struct('license', l, 'of', filter(hs, h -> h.license = l)))"
    return base.selectExpr("doc_id", f"explode({each}) as f").selectExpr("doc_id", "f.license as license", "array_max(transform(f.of, h -> h.c)) as containment", "array_min(transform(f.of, h -> h.at)) as first_word")
