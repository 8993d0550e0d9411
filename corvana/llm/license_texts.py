"""Wordings of public licenses: notices by which works name them, and whole texts of the short ones."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    name: str
    #: Where a block may be: words around a match of this pattern are one.
    anchor: str
    #: What must be among the words that agree (joined by one space, without punctuation).
    needed: tuple[str, ...]
    text: str


#: License wordings.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."""
GIVEN = "Released under the {0}. Licensed under the {0}. This work is licensed under the {0}. This project is licensed under the terms of the {0}. Made available under the {0}. Distributed under the {0}. "
PLAIN_GPL = "(?<!lesser )(?<!affero )general public license|\\b(?:gnu )?gpl"

TEMPLATES = [
    Template("MIT", r"\bmit\b", (r"\bmit\b.{0,12}licen[sc]|licen[sc]\w+ .{0,24}\bmit\b",), GIVEN.format("MIT License")),
    Template("MIT", r"permission is hereby granted", ("permission is hereby granted free of charge", "deal in the software"), MIT),
    Template("BSL-1.0", r"permission is hereby granted|boost software", ("any person or organization|boost software license",), GIVEN.format("Boost Software License, Version 1.0") + BOOST),
    Template("ISC", r"\bisc licen[sc]e", ("isc licen",), GIVEN.format("ISC License")),
    Template("ISC", r"permission to use, copy, modify", ("permission to use copy modify", "with or without fee|appear in all copies"), ISC),
    Template("BSD", r"\bbsd\b", (r"\bbsd\b",), GIVEN.format("BSD License") + GIVEN.format("BSD 3-Clause License") + GIVEN.format("BSD 2-Clause License")),
    Template("BSD", r"redistribution and use in source", ("redistribution and use in source and binary",), f"{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"),
    Template("Unlicense", r"unencumbered software|\bunlicense\b", ("unencumbered software|unlicense",), UNLICENSE),
    Template("Zlib", r"provided 'as-is'|zlib licen[sc]e", ("as-is without any express|zlib licen", "granted to anyone|zlib licen"), GIVEN.format("zlib License") + ZLIB),
    Template("Apache-2.0", r"apache", ("apache", "2\\.0"), GIVEN.format("Apache License, Version 2.0") + APACHE),
    Template("GPL-3.0", r"general public licen[sc]e|\bgpl", (PLAIN_GPL, r"\b(?:version |v)?3"), GIVEN.format("GNU General Public License, version 3") + "This program " + GPL.format("General Public License", 3)),
    Template("GPL-2.0", r"general public licen[sc]e|\bgpl", (PLAIN_GPL, r"\b(?:version |v)?2"), GIVEN.format("GNU General Public License, version 2") + "This program " + GPL.format("General Public License", 2)),
    Template("LGPL", r"lesser general public|\blgpl", (r"lesser general public license|\blgpl",), GIVEN.format("GNU Lesser General Public License, version 3") + GIVEN.format("GNU Lesser General Public License, version 2.1") + "This library " + GPL.format("Lesser General Public License", "2.1")),
    Template("AGPL-3.0", r"affero|\bagpl", (r"affero|\bagpl",), GIVEN.format("GNU Affero General Public License, version 3") + "This program " + GPL.format("Affero General Public License", 3)),
    Template("MPL-2.0", r"mozilla public|\bmpl\b", (r"mozilla public licen|\bmpl\b",), GIVEN.format("Mozilla Public License, Version 2.0") + "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *(
        Template(f"CC-{code}", rf"creative commons attribution|\bcc[ -]by", (rf"creative commons {words}(?!-)|\bcc[ -]{code.lower()}(?!-)",), GIVEN.format(f"CC {code} 4.0") + GIVEN.format(f"Creative Commons {words.title()} 4.0 International License") + GIVEN.format(f"Creative Commons {words.title()} License") + f"licensed under a Creative Commons {words.title()} 4.0 International License")
        for code, words in (("BY", "attribution"), ("BY-SA", "attribution-sharealike"), ("BY-NC", "attribution-noncommercial"), ("BY-ND", "attribution-noderivatives"), ("BY-NC-SA", "attribution-noncommercial-sharealike"), ("BY-NC-ND", "attribution-noncommercial-noderivatives"))
    ),
    Template("CC0-1.0", r"\bcc0\b|waived all copyright", ("cc0|waived all copyright",), GIVEN.format("CC0 1.0 Universal") + "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("Public-Domain", r"public domain", (r"(?:dedicated to|released into|placed in|released to) the public domain",), "This work is dedicated to the public domain. It is released into the public domain. It has been placed in the public domain."),
    Template("Proprietary", r"all rights reserved|may be reproduced", ("all rights reserved|no part .{0,40}may be reproduced",), "Copyright. All rights reserved. No part of this work may be reproduced, distributed or transmitted in any form without prior written permission."),
]
#: Short identifiers, lower-cased, and the name they stand for.
SPDX = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "isc": "ISC", "unlicense": "Unlicense", "zlib": "Zlib", "bsl-1.0": "BSL-1.0", "0bsd": "BSD", "bsd-2-clause": "BSD", "bsd-3-clause": "BSD",
    "gpl-2.0": "GPL-2.0", "gpl-2.0-only": "GPL-2.0", "gpl-2.0-or-later": "GPL-2.0", "gpl-3.0": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "gpl-3.0-or-later": "GPL-3.0",
    "lgpl-2.1": "LGPL", "lgpl-2.1-only": "LGPL", "lgpl-2.1-or-later": "LGPL", "lgpl-3.0": "LGPL", "lgpl-3.0-only": "LGPL", "lgpl-3.0-or-later": "LGPL", "agpl-3.0": "AGPL-3.0", "agpl-3.0-only": "AGPL-3.0", "agpl-3.0-or-later": "AGPL-3.0",
    "mpl-2.0": "MPL-2.0", "cc0-1.0": "CC0-1.0", "cc-by-4.0": "CC-BY-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0", "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0",
}
