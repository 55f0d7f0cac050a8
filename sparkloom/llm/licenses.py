"""Licence scan: normalised whole texts looked up by digest among known licences."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that names a holder: "copyright" with a year, a sign, a placeholder or an owner after it, or a sign with a year. Lines of a
#: wrapped licence that merely begin with that word stay.
COPYRIGHT = (
    r"(?m)^[ \t*#/;-]*(?:copyright\b[ \t:,]*(?:\(c\)|©|[0-9]{4}|[\[<{]|by\b)[^\n]*|copyright\b[^\n]*\b(?:19|20)[0-9]{2}\b[^\n]*"
    r"|copyright (?:the )?[^ \n]+ (?:authors|project|foundation)[^\n]{0,3}|(?:\(c\)|©)[ \t]*(?:copyright\b|(?:19|20)[0-9]{2})[^\n]*|all rights reserved\.?[ \t]*)$"
)
MARKS = r"[^\p{L}\p{N}]+"
#: Spellings that mean the same, as words or groups of words.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sublicenced", "sublicensed"), ("sub licensed", "sublicensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("organisations", "organizations"), ("authorisation", "authorization"), ("authorised", "authorized"), ("merchantibility", "merchantability"), ("favour", "favor"),
    ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("http", "https"), ("analyse", "analyze"), ("recognise", "recognize"),
)

_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."

_UNLICENSE = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution."
_BOOST = "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_WTFPL = "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\n\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."

#: id -> texts. Public licence texts, with and without their title line, and the notices that stand for a licence.
KNOWN: dict[str, list[str]] = {
    "MIT": [f"{t}{_MIT_GRANT}\n\n{_MIT_REST}" for t in ("", "MIT License\n\n", "The MIT License (MIT)\n\n", "The MIT License\n\n")] + ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "ISC": [f"{t}{_ISC}\n\n{_ISC_REST}" for t in ("", "ISC License\n\n")] + ["SPDX-License-Identifier: ISC"],
    "BSD-2-Clause": [f"{t}{_BSD_HEAD}{_BSD_1}{_BSD_2}{_BSD_END}" for t in ("", "BSD 2-Clause License\n")] + ["SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [f"{t}{_BSD_HEAD}{_BSD_1}{_BSD_2}{_BSD_3}{_BSD_END}" for t in ("", "BSD 3-Clause License\n")] + ["SPDX-License-Identifier: BSD-3-Clause"],
    "0BSD": [f"{_ISC.replace(', provided that the above copyright notice and this permission notice appear in all copies', '')}\n\n{_ISC_REST}"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "MIT-0": [f"{t}{_MIT_GRANT.removesuffix(', subject to the following conditions:')}.\n\n{_MIT_REST.partition(chr(10) * 2)[2]}" for t in ("", "MIT No Attribution\n\n")] + ["SPDX-License-Identifier: MIT-0"],
    "Zlib": [f"{t}{_ZLIB}" for t in ("", "zlib License\n\n", "The zlib/libpng License\n\n")] + ["SPDX-License-Identifier: Zlib"],
    "BSL-1.0": [_BOOST, "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "SPDX-License-Identifier: BSL-1.0"],
    "WTFPL": [_WTFPL],
    "Unlicense": [_UNLICENSE, f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org/>"],
}

#: id -> digests of canonical whole texts that are too long to stand here, by digests_of(): of Debian's common-licenses and SPDX's list.
WHOLE: dict[str, list[str]] = {
    "Apache-2.0": ["3ba39f5600f5dbbc80b14323b49807be", "53094782cbe8b2f39d5b3b2a9d896d46", "1df04d5ff9c7949b819e24e0455139b0"],
    "Artistic-1.0-Perl": ["55f5c74896a493fd643a3ce0663343b4"],
    "BSD-3-Clause": ["7a32b1b23a108712414cbd1caed17ece"],
    "CC-BY-SA-4.0": ["77c73b2a07e1f8fdae92f3564c25c1e9"],
    "CC0-1.0": ["95da50da151b848c4af0558455fb385f"],
    "GFDL-1.2-only": ["6f37d492018f49e9a1d50011278c4278", "d1884aaca2788f80eb1f69f87cc37be2"],
    "GFDL-1.3-only": ["45a19a38fc1d51e52b4a6eaa988a6d80", "efea08ab9955d957c0457cbd138b20de"],
    "GPL-1.0-only": ["5afebdc772d1a4897313d51b86b474d5", "8ab9d42928996b1f1a379537a5f407c0", "ec40e13b33cda1a28caa397bb5bb6f8e", "8a5cf4f72f7d6aa423c521099568b5e1", "dcc5da165bda25b48820815334725029", "a04ee6783405a2998570e8d8e97c5a83"],
    "GPL-2.0-only": ["301fe671546fecb8937d6bae2c0781fc", "e2aa6e17bd4a6e45d74e22130c89bc6e", "fd878e4b1b0eb46fea06d025f233cd3e", "6ba32878b253b9b805f1dd3c47f2cad4", "55af9c99993f4446fd67fd8b9b554c55", "85ed8adaa5022270b825c4dea5bded94", "b0cea0241b91b0c1826f503593ad1d13", "b5d7c51376a1ff591f9d9a4b55cf76ed", "9b9bb3a72adb8a53c878d23f6a0836b7", "1f261ab558f6376f0850e87f94899615", "e6c4b41875d8144a9a5821f10dbb231a", "a89ee553f341b65f4d03bb0b0b5fe214"],
    "GPL-3.0-only": ["3740331a95b965385b348c20f2e046d0", "44b64a464efd992182592aaaea02432f", "3be5521ca942fef0cb37a68ee3a5149d", "d48bcd838a7239ce34a3317dd262b868", "61a069a74b73b65397a8512dd88c0ba3", "fd52f482b19b00e80f67ef8f613903da", "c62be0f4f8d93258892b89453e8e13bb"],
    "LGPL-2.0-only": ["88469a34fbc1c66683ce6fe8c12a0f1d", "71bef30846997ff3c28267696e98f0f0", "4a0c7fb99ac95648a95d00d1912935a8", "b524f5a7213e4cdd319531990053b7cf", "c7a74d6fa39ecb89df4299b4a6d2a6d8", "b43ec091c531641baa5fe0fb87aef49a"],
    "LGPL-2.1-only": ["517af84c02a2ce0794e9c87618f666e8", "383a064ee49fdcf9bb5a54c6ae3b296f", "1b7a316fa32f35aab094be0992f3a4db", "56161cc2f828e43eb056671a0f9d95d7", "53dcd2d1e4ef2d57a59db4695b4ede92", "afcd98be6452d058f97b5d318d4a6d65"],
    "LGPL-3.0-only": ["281a41d72608f10f9238d3968ad22076", "5b7b90275b6aab98eb1a8179c516d137"],
    "MPL-1.1": ["777294065ecef3adc1acf7e3aaecc26a"],
    "MPL-2.0": ["fcf24c2ba6baf47ec24b32552a964021"],
    "NCSA": ["ac3a804b55019fad55ab143f2f9cdc9d"],
    "OFL-1.1": ["bd0bc1132c6b6bc46f8b924512d2e455"],
    "Unicode-3.0": ["56943384aec0a374ae29be603bf80b6b"],
}


def canonical(text: Column) -> Column:
    """The text in lower case without copyright lines, each run of other characters than letters and digits as two
    spaces (so that neighbouring words can both be replaced), equivalent spellings made one."""
    out = F.concat(F.lit("  "), F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), MARKS, "  "), F.lit("  "))
    out = F.regexp_replace(out, "   +", "  ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return out


def canonical_py(text: str) -> str:
    """canonical() for the known texts, which hold no other numerals than digits."""
    out = re.sub(r"[\W_]+", "  ", re.sub(COPYRIGHT, "", text.lower()))
    out = re.sub("   +", "  ", f"  {out}  ")
    for a, b in SPELLINGS:
        out = out.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    return out


def unwrapped(text: str) -> str:
    """The text with one line a paragraph."""
    return re.sub(r"[ \t]*\n[ \t]*(?=\S)", " ", text)


def digests_of(text: str) -> list[str]:
    """The digests by which a whole licence text is known: as it is, up to the end of its terms (with and without the line that says so),
    wrapped and with one line a paragraph."""
    end = "END OF TERMS AND CONDITIONS"
    parts = [text] + ([text[: text.index(end)], text[: text.index(end) + len(end)]] if f"{end}\n" in text else [])
    return list(dict.fromkeys(hashlib.md5(canonical_py(t).encode()).hexdigest() for p in parts for t in (p, unwrapped(p))))


def digests(known: dict[str, list[str]] = KNOWN, whole: dict[str, list[str]] = WHOLE) -> list[tuple[str, str]]:
    """(digest, licence id) of each known text; of two ids with one text the smaller stays, and a text goes before a digest."""
    found = {d: name for name, ds in sorted(whole.items(), reverse=True) for d in ds}
    for name, texts in sorted(known.items(), reverse=True):
        found |= {hashlib.md5(canonical_py(t).encode()).hexdigest(): name for t in texts}
    return sorted(found.items())


def scan_licenses(docs: DataFrame, known: dict[str, list[str]] = KNOWN, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest, license) for each row: the digest of its whole canonical text and the licence that has it, or null.

    Null text: null digest. Empty text, or one of marks alone: the digest of no words, which no licence has.
    Repeated rows are answered each, an empty table gives none; a long text is normalised and digested whole. Only key and digest meet the table of digests, which comes with the code and
    is broadcast for that reason.
    """
    names = docs.sparkSession.createDataFrame(digests(known), "digest string, license string")
    return docs.select(F.col(key), F.md5(canonical(F.col(text))).alias("digest")).join(F.broadcast(names), "digest", "left").select(key, "digest", "license")


def canonical_sql(text: str = "text") -> str:
    out = f"'  ' || regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', '', 'g'), '{MARKS}', '  ', 'g') || '  '"
    out = f"regexp_replace({out}, '   +', '  ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return out
