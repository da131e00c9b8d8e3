"""Identify licence texts by the digest of their canonical form.

The canonical form lowers case, drops copyright notices, list numbers, comment marks and punctuation, brings
equivalent spellings together and joins words by one space. A licence is found where the canonical form of a
run of whole lines is that of a known text: the whole text, a paragraph, several, or one line. Runs are looked
up by an equality join of 256-bit digests. Only runs that begin with the first word of a known text and
have as many words as it are digested, so a text costs about as much as counting its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keyed, sent_if_small
from tidemark.llm.words import slices

# Spellings that count as one.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorised": "authorized", "authorisation": "authorization",
    "favour": "favor", "fulfil": "fulfill", "merchantibility": "merchantability", "acknowledgement": "acknowledgment",
    "http": "https", "whilst": "while", "initialisation": "initialization", "judgement": "judgment", "holders": "holder", "owner": "holder",
}

# Short public licence texts and the notices that stand for long ones.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "MIT-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present
and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please
refer to <https://unlicense.org>""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}

# Names by which one line may declare a licence, each with the licence it stands for.
DECLARED = {
    "MIT": "MIT", "MIT License": "MIT", "ISC": "ISC", "ISC License": "ISC",
    "Apache-2.0": "Apache-2.0", "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0",
    "BSD-2-Clause": "BSD-2-Clause", "BSD 2-Clause License": "BSD-2-Clause",
    "BSD-3-Clause": "BSD-3-Clause", "BSD 3-Clause License": "BSD-3-Clause",
    "GPL-2.0-only": "GPL-2.0-only", "GNU General Public License, version 2": "GPL-2.0-only",
    "GPL-3.0-only": "GPL-3.0-only", "GNU General Public License, version 3": "GPL-3.0-only",
    "GPL-3.0-or-later": "GPL-3.0-or-later", "GNU General Public License, version 3 or later": "GPL-3.0-or-later",
    "LGPL-3.0-only": "LGPL-3.0-only", "GNU Lesser General Public License, version 3": "LGPL-3.0-only",
    "AGPL-3.0-only": "AGPL-3.0-only", "GNU Affero General Public License, version 3": "AGPL-3.0-only",
    "MPL-2.0": "MPL-2.0", "Mozilla Public License, version 2.0": "MPL-2.0", "Mozilla Public License 2.0": "MPL-2.0",
    "CC0-1.0": "CC0-1.0", "CC0 1.0": "CC0-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC BY 4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "Unlicense": "Unlicense",
}
DECLARATIONS = (
    "SPDX-License-Identifier: {}", "License: {}", "Licensed under {}", "Licensed under the {}", "Released under {}",
    "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}",
    "Licensed under the {} license", "Released under the {} license",
)
# Titles that may stand before a text; the names above may as well.
TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)"], "MIT-0": ["MIT No Attribution"], "0BSD": ["BSD Zero Clause License"],
    "BSD-2-Clause": ["The 2-Clause BSD License", "Simplified BSD License"], "BSD-3-Clause": ["The 3-Clause BSD License", "New BSD License"],
    "Zlib": ["zlib License", "The zlib License"], "Unlicense": ["The Unlicense"],
}

# A line is a notice, and dropped, if a mark, a year or a place holder follows, or if rights are all it speaks of.
_EDGE = r"[\s/*#;%.!>-]*"
_NOTICE = re.compile(
    rf"{_EDGE}(?:copyright[\s:,]*(?:\(c\)|©|&copy;|\d|[<\[{{]|by\b)|(?:\(c\)|©)\s*(?:copyright\b|\d|[<\[{{])|all rights reserved[\s.*/#]*$)"
)
_NUMBER = re.compile(rf"{_EDGE}\(?\d{{1,2}}[.)](?=\s)")
_WORD = re.compile(r"(?:[^\W_]|\.(?=\d))+")
_LONG_LINE = 1 << 16


def _body(line: str) -> str:
    """What of a line counts: nothing of a notice, no list number."""
    line = line.lower()
    if ("copyright" in line or "(c)" in line or "©" in line or "rights" in line) and _NOTICE.match(line):
        return ""
    number = _NUMBER.match(line)
    return (line[number.end():] if number else line).replace("non-infringement", "noninfringement")


def _words(body: str) -> list[str]:
    return [SPELLINGS.get(w, w) for w in _WORD.findall(body)]


def canonical(text: str) -> str:
    """The canonical form of a text; empty if nothing is left."""
    return " ".join(w for line in text.split("\n") for w in _words(_body(line)))


def known_licences(spark: SparkSession) -> DataFrame:
    """``licence, text``: the texts above, with and without a title, and every way a line may declare a licence."""
    rows = list(KNOWN.items())
    for licence, text in KNOWN.items():
        names = [name for name, meant in DECLARED.items() if meant == licence]
        rows += [(licence, f"{title}\n{text}") for title in names + TITLES.get(licence, [])]
    rows += [(licence, form.format(name)) for name, licence in DECLARED.items() for form in DECLARATIONS]
    return spark.createDataFrame(rows, "licence string, text string")


def _digest(form: str) -> str:
    return hashlib.sha256(form.encode("utf-8", "surrogatepass")).hexdigest()


def _slot(word: str) -> int:
    """Which of 4,096 groups of first words a word is in."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=2).digest()) & 4095


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for licence, text in zip(batch.column("licence").to_pylist(), batch.column("text").to_pylist()):
            words = canonical(text or "").split()
            if words:
                rows.append((licence, _digest(" ".join(words)), _slot(words[0]), len(words)))
        columns = list(zip(*rows)) or [[]] * 4
        types = (pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["licence", "digest", "slot", "length"])


def runs_of_lines(text: str, shapes: dict[int, list[int]]) -> set[tuple[str, bool]]:
    """Digest of each run of whole lines whose first word and number of words (``shapes``: lengths by slot
    of the first word) a known text has, and whether it is the whole text."""
    longest = max((lengths[-1] for lengths in shapes.values()), default=0)
    bodies, starts, slots = [], [0], []
    for line in text.split("\n"):
        body = _body(line)
        if len(body) > _LONG_LINE:
            # More words than any known text has are counted as one more than that.
            found = [m[0] for m in islice(_WORD.finditer(body), longest + 1)]
        else:
            found = _WORD.findall(body)
        if found:
            bodies.append(body)
            slots.append(_slot(SPELLINGS.get(found[0], found[0])) if shapes else -1)
            starts.append(starts[-1] + len(found))
    at = {start: i for i, start in enumerate(starts)}
    forms: dict[int, str] = {}

    def form(i: int) -> str:
        if i not in forms:
            forms[i] = " ".join(_words(bodies[i]))
        return forms[i]

    runs = set()
    for i, slot in enumerate(slots):
        for length in shapes.get(slot, ()):
            end = at.get(starts[i] + length)
            if end is not None:
                runs.add((_digest(" ".join(map(form, range(i, end)))), i == 0 and end == len(bodies)))
    return runs


def _runs(shapes: dict[int, list[int]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            held = data.tobytes()
            rows, digests, whole = [], [], []
            for row, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for digest, all_of_it in runs_of_lines(held[s:e].decode("utf-8", "replace"), shapes):
                    rows.append(row)
                    digests.append(digest)
                    whole.append(all_of_it)
            of = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(of), batch.column("th").take(of), pa.array(digests, pa.string()), pa.array(whole, pa.bool_())],
                ["doc", "th", "digest", "whole"],
            )

    return find


def find_licences(
    docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    licence_col: str = "licence", licence_text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs``: its id, ``whole`` (licences whose text is the whole text), ``licences`` (those of
    any run of its lines too), both sorted, and the keys ``doc, th``.

    Lines end at a line feed. Lines without a word and copyright notices (a mark, a year, a place holder or "by"
    follows; or "all rights reserved" alone) belong to any run around them. Null, empty and blank texts match
    nothing, nor do licences without words; a null licence name is never given. Several licences may share a
    digest; all are given. Rows that repeat an id with an equal text are one document. Other columns are
    ignored. An empty table on either side gives no licences. Of the licences, only which lengths begin with
    which of 4,096 groups of words goes through the driver.
    """
    source = keyed(docs, id_col, text_col)
    digests = licences.select(
        F.col(f"`{licence_col}`").cast("string").alias("licence"), F.col(f"`{licence_text_col}`").cast("string").alias("text")
    ).mapInArrow(_known, "licence string, digest string, slot int, length int").distinct()
    lengths = digests.groupBy("slot").agg(F.sort_array(F.collect_set("length")).alias("lengths")).collect()
    found = (
        source.filter("text is not null")
        .select("doc", "th", "text")
        .mapInArrow(_runs({r.slot: r.lengths for r in lengths}), "doc long, th long, digest string, whole boolean")
        .join(sent_if_small(digests.select("digest", "licence").distinct(), 200), "digest")
        .groupBy("doc", "th")
        .agg(
            F.sort_array(F.collect_set("licence")).alias("licences"),
            F.sort_array(F.collect_set(F.when(F.col("whole"), F.col("licence")))).alias("whole"),
        )
    )
    none = F.array().cast("array<string>")
    return source.join(found, ["doc", "th"], "left").select(
        F.col("id").alias(id_col), F.coalesce("whole", none).alias("whole"), F.coalesce("licences", none).alias("licences"), "doc", "th"
    )
