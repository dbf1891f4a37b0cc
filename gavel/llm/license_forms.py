"""Entire texts of licences and the headers that they ask for, in the forms in which files carry them.

`license_texts` holds the long ones as published. Forms differ in titles, list
numbers, addresses and the names that a licence leaves open. AGPL-3.0,
CC-BY-4.0, CC-BY-NC-4.0 and CC-BY-NC-SA-4.0 are held as their differences from
GPL-3.0 and CC-BY-SA-4.0.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import product
from pathlib import Path

_WARRANTY = "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_TERMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
# Who gives no warranty and who is not liable; whose name is no endorsement.
_PARTIES = [("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", f"THE COPYRIGHT {x} CONTRIBUTORS") for x in ("HOLDER OR", "HOLDERS OR", "OWNER OR", "OWNERS OR")] + [("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"), ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"), ("THE AUTHOR", "THE AUTHOR")]
_WHOSE = ["the copyright holder", "the copyright holders", "the <organization>", "the University"]
_SOURCE = ["https://www.gnu.org/licenses/", "http://www.gnu.org/licenses/"]
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at {}://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
_GNU = "This program is free software{} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
_GNU_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
_GNU_COPY = "You should have received a copy of the {name} along with this program. If not, see <{at}>."
# Fixed values: (words of GPL-3.0, words of AGPL-3.0 in their place); "..." stands for all that is between.
_AFFERO = [
    ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("By contrast, the GNU General Public License is intended to guarantee", "By contrast, our General Public Licenses are intended to guarantee"),
    ("We, the Free Software Foundation, use ... to your programs, too.", ""),
    ("To protect your rights, we need to prevent ... so they know their rights.", ""),
    ("Developers that use the GNU GPL protect your rights with two steps:", "Developers that use our General Public Licenses protect your rights with two steps:"),
    ("this License giving you legal permission to copy, distribute and/or modify it.", "this License which gives you legal permission to copy, distribute and/or modify the software."),
    ("For the developers' and authors' protection, ... to render the program non-free.", "A secondary benefit of defending all users' freedom is that improvements made in alternate versions of the program, if they receive widespread use, become available for other developers to incorporate. Many developers of free software are heartened and encouraged by the resulting cooperation. However, in the case of software used on network servers, this result may fail to come about. The GNU General Public License permits making a modified version and letting the public access it on a server without ever releasing its source code to the public. The GNU Affero General Public License is designed specifically to ensure that, in such cases, the modified source code becomes available to the community. It requires the operator of a network server to provide the source code of the modified version running there to the users of that server. Therefore, public use of a modified version, on a publicly accessible server, gives the public access to the source code of the modified version. An older license, called the Affero General Public License and published by Affero, was designed to accomplish similar goals. This is a different license, not a version of the Affero GPL, but Affero has released a new version of the Affero GPL which permits relicensing under this license."),
    ("\"This License\" refers to version 3 of the GNU General Public License.", "\"This License\" refers to version 3 of the GNU Affero General Public License."),
    ("13. Use with the GNU Affero General Public License. ... to the combination as such.", "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will remain governed by version 3 of the GNU General Public License."),
    ("revised and/or new versions of the GNU General Public License from", "revised and/or new versions of the GNU Affero General Public License from"),
    ("a certain numbered version of the GNU General Public License", "a certain numbered version of the GNU Affero General Public License"),
    ("a version number of the GNU General Public License,", "a version number of the GNU Affero General Public License,"),
    ("which future versions of the GNU General Public License can", "which future versions of the GNU Affero General Public License can"),
    ("under the terms of the GNU General Public License as", "under the terms of the GNU Affero General Public License as"),
    ("See the GNU General Public License for more details.", "See the GNU Affero General Public License for more details."),
    ("received a copy of the GNU General Public License along", "received a copy of the GNU Affero General Public License along"),
    ("If the program does terminal interaction, ... you would use an \"about box\".", "If your software can interact with users remotely through a computer network, you should also make sure that it provides a way for users to get its source. For example, if your program is a web application, its interface could display a \"Source\" link that leads users to an archive of the code. There are many ways you could offer source, and different solutions will be better for different programs; see section 13 for the specific requirements."),
    ("apply and follow the GNU GPL, see", "apply and follow the GNU AGPL, see"),
    ("The GNU General Public License does not permit incorporating ... <https://www.gnu.org/licenses/why-not-lgpl.html>.", ""),
]
# Fixed values: (words of CC-BY-SA-4.0, words in their place) in licences without share-alike terms, and in those for non-commercial use.
_NOT_ALIKE = [
    ("c. BY-SA Compatible License means ... equivalent of this Public License.", ""),
    ("g. License Elements means ... Attribution and ShareAlike.", ""),
    ("b. Additional offer from the Licensor ... the Adapter's License You apply. c. No downstream", "b. No downstream"),
    ("b. ShareAlike. In addition to ... granted under the Adapter's License You apply.", "4. If You Share Adapted Material You produce, the Adapter's License You apply must not prevent recipients of the Adapted Material from complying with this Public License."),
    ("is Adapted Material, including for purposes of Section 3(b); and", "is Adapted Material; and"),
]
_NONCOMMERCIAL = [
    ("k. Share means", "k. NonCommercial means not primarily intended for or directed towards commercial advantage or monetary compensation. For purposes of this Public License, the exchange of the Licensed Material for other material subject to Copyright and Similar Rights by digital file-sharing or similar means is NonCommercial provided there is no payment of monetary compensation in connection with the exchange.\n\n  k. Share means"),
    ("reproduce and Share the Licensed Material, in whole or in part; and", "reproduce and Share the Licensed Material, in whole or in part, for NonCommercial purposes only; and"),
    ("produce, reproduce, and Share Adapted Material.", "produce, reproduce, and Share Adapted Material for NonCommercial purposes only."),
    ("reserves any right to collect such royalties.", "reserves any right to collect such royalties, including when the Licensed Material is used other than for NonCommercial purposes."),
    ("portion of the contents of the database; b.", "portion of the contents of the database for NonCommercial purposes only; b."),
]
_NONCOMMERCIAL_ALIKE = [("BY-SA Compatible License", "BY-NC-SA Compatible License"), ("are Attribution and ShareAlike.", "are Attribution, NonCommercial, and ShareAlike.")]
# Titles beside the names by which notices cite a licence.
TITLES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "BSD-2-Clause": ["The 2-Clause BSD License", "BSD License"],
    "BSD-3-Clause": ["The 3-Clause BSD License", "BSD License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "MIT": ["The MIT License (MIT)", "MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "UNLICENSE"],
}


def _bsd(clauses: int) -> list[str]:
    made = []
    for (by, liable), whose, named, shut in product(_PARTIES, _WHOSE if clauses == 3 else [""], ("the names of its", "the names of"), ("", "1")):
        terms = _TERMS + [f"Neither the name of {whose} nor {named} contributors may be used to endorse or promote products derived from this software without specific prior written permission."] * (clauses == 3)
        listed = [f"{i}. {t}" if shut else t for i, t in enumerate(terms, 1)]
        made.append(" ".join([_GRANT, *listed, _WARRANTY.format(by, liable)]))
    return sorted(set(made))


def _headers() -> list[tuple[str, str]]:
    made = [("Apache-2.0", _APACHE.format(x)) for x in ("http", "https")] + [("MPL-2.0", _MPL.format(x)) for x in ("http", "https")]
    for licence, name, version in (("GPL-2.0", "GNU General Public License", 2), ("GPL-3.0", "GNU General Public License", 3), ("LGPL-3.0", "GNU Lesser General Public License", 3), ("AGPL-3.0", "GNU Affero General Public License", 3)):
        grant = _GNU.format(":", name=name, version=version)
        made += [(licence, grant)] + [(licence, " ".join([grant, _GNU_REST.format(name=name), _GNU_COPY.format(name=name, at=at)])) for at in _SOURCE]
    return made


def _edited(text: str, edits: list[tuple[str, str]]) -> str:
    """text with words in the place of others, wherever lines break."""
    for old, new in edits:
        words = [r".*?" if w == "..." else re.escape(w) for w in old.split()]
        text, n = re.subn(r"\s+".join(words), lambda _: new, text, flags=re.S)  # noqa: B023
        if not n:
            raise ValueError(f"not in the text: {old}")
    return text


def _lettered(text: str) -> str:
    """A Creative Commons text whose definitions have letters in order."""
    start, stop = text.index("Section 1 -- Definitions."), text.index("Section 2 --")
    letters = iter("abcdefghijklmnopqrstuvwxyz")
    return text[:start] + re.sub(r"(?m)^  [a-z]\. ", lambda _: f"  {next(letters)}. ", text[start:stop]) + text[stop:]


@cache
def published() -> dict[str, str]:
    """Entire texts as published: the files of license_texts, and those that are held as differences."""
    held = {p.stem: p.read_text() for p in (Path(__file__).parent / "license_texts").glob("*.txt")}
    alike = held["CC-BY-SA-4.0"]
    named = lambda text, name: _lettered(text.replace("Attribution-ShareAlike", name))
    held["AGPL-3.0"] = _edited(held["GPL-3.0"], _AFFERO)
    held["CC-BY-4.0"] = named(_edited(alike, _NOT_ALIKE), "Attribution")
    held["CC-BY-NC-4.0"] = named(_edited(alike, _NONCOMMERCIAL + _NOT_ALIKE), "Attribution-NonCommercial")
    held["CC-BY-NC-SA-4.0"] = named(_edited(alike, _NONCOMMERCIAL + _NONCOMMERCIAL_ALIKE), "Attribution-NonCommercial-ShareAlike")
    return dict(sorted(held.items()))


def _published() -> list[tuple[str, str]]:
    """Published texts: as they are, with other addresses, and up to the end of their terms."""
    made = []
    for licence, text in published().items():
        forms = {text, text.replace("https://", "http://"), re.sub(r"(?m)^ 51 Franklin.*\n", "", text)}
        made += [(licence, x) for x in forms] + [(licence, x[: m.end()]) for x in forms for m in re.finditer("END OF TERMS AND CONDITIONS", x)]
        if licence == "MPL-2.0":
            made += [(licence, text[: text.index("Exhibit A - ")])]
        if licence.startswith("CC-"):
            terms = text[text.index("By exercising the Licensed Rights") :]
            made += [(licence, terms[: terms.index("=====")])]
    return sorted(set(made))


def bodies(short: dict[str, str]) -> list[tuple[str, str]]:
    """(licence, text) without titles: `short` texts, the forms of BSD and Unlicense, headers and published files."""
    unlicense = [_UNLICENSE] + [f"{_UNLICENSE} For more information, please refer to <{x}://unlicense.org/>" for x in ("http", "https")]
    made = [*short.items(), *(("Unlicense", x) for x in unlicense)]
    made += [(f"BSD-{n}-Clause", x) for n in (2, 3) for x in _bsd(n)]
    return made + _headers() + _published()


def titles(names: dict[str, list[str]]) -> dict[str, list[str]]:
    """Titles that stand above entire texts, by licence."""
    return {k: [f"{the}{t}" for t in x + TITLES.get(k, []) for the in ("", "The ")] for k, x in names.items()}
