"""License wordings in template markup.

<<beginOptional>> ... <<endOptional>> encloses words that may be missing;
<<var;name="...";original="...";match="...">> stands for words that may be
replaced by any that the expression accepts.  Everything else is mandatory.
"""

from chronotext.llm.license_texts import TEXTS

ANY = '<<var;name="any";original="";match=".{0,5000}">>'
COPYRIGHT = f"<<beginOptional>>Copyright (c) {ANY}<<endOptional>><<beginOptional>>All rights reserved.<<endOptional>>"
VERSION = lambda original, match: f'<<var;name="version";original="{original}";match="{match}">>'
HOLDER = '<<var;name="holder";original="the copyright holders and contributors";match=".{1,120}">>'

_IDS = r"mit|isc|zlib|unlicense|0bsd|bsl 1\.0|apache [12]\.[01]|mpl [12]\.[01]|bsd [234] clause|[al]?gpl [123](\.[0-9])?( only| or later)?|cc0 1\.0|cc by( nc| sa| nd)* [1-4]\.[0-9]"

_BSD_TAIL = f"""
THIS SOFTWARE IS PROVIDED BY {HOLDER} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
{HOLDER} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions
in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_GNU = lambda name, numbers: f"""This program is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the
terms of the GNU {name} as published by the Free Software Foundation; either version {VERSION(numbers, "[0-9.]+")} of the
License<<beginOptional>>, or (at your option) any later version<<endOptional>>."""  # noqa: E731

#: (identifier, kind, template)
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", f"""<<beginOptional>>MIT License<<endOptional>>{COPYRIGHT}
Permission is hereby granted, free of charge, to any person obtaining a copy of
<<var;name="what";original="this software and associated documentation files";match="this software and associated documentation files|this software">> (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice
<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions
of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
{HOLDER} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", "text", f"""<<beginOptional>>ISC License<<endOptional>>{COPYRIGHT}
Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{{1,80}}">> DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL <<var;name="author";original="THE AUTHOR";match=".{{1,80}}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("BSD-2-Clause", "text", f"{COPYRIGHT}{_BSD_HEAD}{_BSD_TAIL}"),
    ("BSD-3-Clause", "text", f"""{COPYRIGHT}{_BSD_HEAD} <<beginOptional>>3.<<endOptional>> Neither the name of
<<var;name="organization";original="the copyright holder";match=".{{1,120}}">> nor the names of its contributors may be
used to endorse or promote products derived from this software without specific prior written permission.{_BSD_TAIL}"""),
    ("Zlib", "text", f"""{COPYRIGHT}This software is provided 'as-is', without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of this software. Permission is granted to
anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>>
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", "text", """This is free and unencumbered software released into the public domain. Anyone is free to
copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means.
<<beginOptional>>In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large
and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
<<beginOptional>>For more information, please refer to <http://unlicense.org/><<endOptional>><<endOptional>>"""),
    ("0BSD", "text", f"""{COPYRIGHT}Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{{1,80}}">>
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN
NO EVENT SHALL <<var;name="author";original="THE AUTHOR";match=".{{1,80}}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("BSL-1.0", "text", """<<beginOptional>>Boost Software License - Version 1.0 - August 17th, 2003<<endOptional>> Permission is hereby
granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license
grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE
SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    *((name, "text", text) for name, text in TEXTS.items()),
    ("Apache-2.0", "header", f"""<<beginOptional>>Copyright {ANY}<<endOptional>>Licensed under the Apache License, Version
2.0 (the "License"); you may not use <<var;name="what";original="this file";match="this file|this work|these files">>
except in compliance with the License. You may obtain a copy of the License at
<<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<endOptional>> Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""),
    ("MPL-2.0", "header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("GPL", "header", _GNU("General Public License", "2")),
    ("LGPL", "header", _GNU("<<beginOptional>>Lesser<<endOptional>><<beginOptional>>Library<<endOptional>> General Public License", "2.1")),
    ("AGPL", "header", _GNU("Affero General Public License", "3")),
    ("Apache", "notice", f"""<<beginOptional>>This work is<<endOptional>><<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under
the <<beginOptional>>terms of the<<endOptional>> Apache License<<beginOptional>>, Version {VERSION("2.0", "[0-9.]+")}<<endOptional>>."""),
    ("MIT", "notice", """<<beginOptional>>This work is<<endOptional>><<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under
the <<beginOptional>>terms of the<<endOptional>> MIT License."""),
    ("BSD", "notice", f"""<<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under
the <<var;name="kind";original="3-Clause";match="|[0-9] clause|new|modified|simplified|revised">> BSD License."""),
    ("GPL", "notice", f"""<<beginOptional>>This work is<<endOptional>><<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under
the <<beginOptional>>terms of the<<endOptional>> GNU <<var;name="kind";original="";match="|lesser|affero|library">> General
Public License<<beginOptional>>, version {VERSION("3", "[0-9.]+")}<<endOptional>>."""),
    ("CC", "notice", f"""<<beginOptional>>This work is<<endOptional>><<beginOptional>>Released<<endOptional>><<beginOptional>>Licensed<<endOptional>> under
<<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> CC <<var;name="kind";original="BY";match="by|by sa|by nc|by nd|by nc sa|by nc nd">>
<<beginOptional>>{VERSION("4.0", "[0-9.]+")}<<endOptional>><<beginOptional>>license<<endOptional>>."""),
    ("CC", "notice", f"""licensed under a Creative Commons Attribution<<var;name="kind";original="";match=".{{0,40}}">>
{VERSION("4.0", "[0-9.]+")} International License."""),
    ("SPDX", "tag", f"""SPDX-License-Identifier: <<var;name="id";original="MIT";match="{_IDS}">>"""),
]
