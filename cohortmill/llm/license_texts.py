"""The wording of common licenses and notices, with regions that may be left out or replaced.

`<<opt>> ... <<end>>` may be left out and may hold further such regions, `<<any n>>` stands for up to n words. Case and
punctuation don't count.
"""

_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE <<opt>>AND NONINFRINGEMENT<<end>>. IN NO EVENT SHALL <<any 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<opt>>1<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<opt>>2<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED <<opt>>BY <<any 14>><<end>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 14>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAME = """Neither the name of <<any 14>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_ADVERT = """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by <<any 20>>."""
_GNU_END = """<<opt>><<any 4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the <<any 4>> General Public License for more details. <<opt>>You should have received a copy of the <<any 4>> General Public License along with <<any 4>>
<<opt>>if not <<opt>>see http<<opt>>s<<end>> www gnu org licenses<<end>><<end>><<end>><<end>>"""


def _gnu(name: str, version: str) -> str:
    return f"""is free software <<opt>>you can<<end>> redistribute it and/or modify it under the terms of the {name} General Public License as published by the Free Software Foundation
<<opt>>either<<end>> version {version} <<opt>>of the License<<end>> <<opt>>or at your option any later version<<end>> {_GNU_END}"""


def _named(name: str) -> str:
    return f"licensed under <<opt>>the<<end>> <<opt>>terms of the<<end>> <<opt>>a<<end>> {name}"


def _commons(name: str) -> str:
    return f"licensed under <<opt>>a<<end>> <<opt>>the<<end>> creative commons {name} <<any 2>> <<opt>>international<<end>> <<opt>>unported<<end>> license"


TEMPLATES = (
    ("mit", "released under the <<opt>>terms of the<<end>> mit license"),
    ("mit", _named("mit license")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this <<any 3>> and associated documentation files <<opt>>the software<<end>> to deal in the software without restriction"),
    ("mit-text", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial
portions of the Software. {_MIT_END}"""),
    ("mit-0", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
furnished to do so. {_MIT_END}"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", f"{_BSD_START} {_BSD_END}"),
    ("bsd-3", f"{_BSD_START} <<opt>>3<<end>> {_BSD_NAME} {_BSD_END}"),
    ("bsd-4", f"{_BSD_START} <<opt>>3<<end>> {_BSD_ADVERT} <<opt>>4<<end>> {_BSD_NAME} {_BSD_END}"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is
granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1<<end>> The origin of this
software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. <<opt>>2<<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3<<end>> This notice may not be removed or altered
from any source distribution."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use,
reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following"""),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. <<opt>>In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. <<opt>>We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.<<end>><<end>>"""),
    ("wtfpl", "TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION <<opt>>0<<end>> You just DO WHAT THE FUCK YOU WANT TO"),
    ("postgresql", """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above
copyright notice and this paragraph and the following two paragraphs appear in all copies."""),
    ("apache-2", "licensed under the apache license version 2 0 <<opt>>the license <<opt>>you may not use this file except in compliance with the license<<end>><<end>>"),
    ("apache-2-text", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http<<opt>>s<<end>>://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2", _gnu("GNU", "2")),
    ("gpl-3", _gnu("GNU", "3")),
    ("lgpl-2.1", _gnu("GNU Lesser", "2.1")),
    ("lgpl-3", _gnu("GNU Lesser", "3")),
    ("agpl-3", _gnu("GNU Affero", "3")),
    ("gpl-2", _named("gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 2")),
    ("gpl-3", _named("gnu general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3")),
    ("lgpl-3", _named("gnu lesser general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3")),
    ("agpl-3", _named("gnu affero general public license <<opt>>as published by the free software foundation<<end>> <<opt>>either<<end>> version 3")),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<opt>>If a copy of the MPL was not distributed with this file, You can obtain one at
http<<opt>>s<<end>> mozilla org MPL 2 0<<end>>"""),
    ("epl-2", "are made available under the terms of the eclipse public license <<opt>>v<<end>> 2 0"),
    ("eupl-1.2", "licensed under the eupl <<opt>>version<<end>> 1 2"),
    ("ofl-1.1", "font software is licensed under the sil open font license version 1 1"),
    ("artistic-2", _named("artistic license <<opt>>version<<end>> 2 0")),
    ("cc0", "has waived all copyright and related or neighboring rights to"),
    ("cc0", "creative commons <<opt>>cc0<<end>> 1 0 universal <<opt>>public domain dedication<<end>>"),
    ("cc-by", _commons("attribution")),
    ("cc-by-sa", _commons("attribution sharealike")),
    ("cc-by-nd", _commons("attribution noderivatives")),
    ("cc-by-nc", _commons("attribution noncommercial")),
    ("cc-by-nc-sa", _commons("attribution noncommercial sharealike")),
    ("cc-by-nc-nd", _commons("attribution noncommercial noderivatives")),
    ("cc-by", "licensed under <<opt>>a<<end>> cc by 4 0"),
    ("cc-by-sa", "licensed under <<opt>>a<<end>> cc by sa <<any 2>> <<opt>>license<<end>>"),
    ("cc-by-nc", "licensed under <<opt>>a<<end>> cc by nc <<any 2>> <<opt>>license<<end>>"),
)
