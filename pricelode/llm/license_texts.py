"""License wordings. The texts and notices that the licenses themselves prescribe,
and their usual short forms; versions and kinds of one family come from a rule."""

from __future__ import annotations

#: License: (key words, wordings). A block in which one of the wording's own key words is missing is another license's.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("mit",), (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license.",
    )),
    "MIT-text": (("permission", "hereby", "granted"), (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    )),
    "ISC": (("isc",), ("Licensed under the ISC License.", "Released under the ISC License.")),
    "ISC-text": (("permission", "fee", "hereby"), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    )),
    "Apache-2.0": (("apache", "2.0"), (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    )),
    "MPL-2.0": (("mozilla", "2.0"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    )),
    "EPL-2.0": (("eclipse", "2.0"), (
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    )),
    "BSD-3-Clause": (("bsd", "3-clause"), ("Licensed under the BSD 3-Clause License.",)),
    "BSD-2-Clause": (("bsd", "2-clause"), ("Licensed under the BSD 2-Clause License.",)),
    "BSD-text": (("redistribution", "source", "binary"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    )),
    "Zlib": (("zlib",), ("Licensed under the zlib License.",)),
    "Zlib-text": (("altered", "misrepresented", "origin"), (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
        "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    )),
    "BSL-1.0": (("boost", "1.0"), (
        "Distributed under the Boost Software License, Version 1.0.",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    )),
    "BSL-1.0-text": (("machine-executable",), (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        "\"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, "
        "this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such "
        "copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    )),
    "CC0-1.0": (("cc0",), ("Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0.")),
    "Unlicense": (("public", "domain"), (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    )),
    "WTFPL": (("everyone", "permitted", "verbatim"), (
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    )),
    "all-rights-reserved": (("rights", "reserved"), ("All rights reserved.", "Copyright. All rights reserved.")),
}


def _add(name: str, keys: tuple[str, ...], *texts: str) -> None:
    old_keys, old = TEMPLATES.get(name, ((), ()))
    TEMPLATES[name] = (tuple(dict.fromkeys((*old_keys, *keys))), (*old, *texts))


_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code "
    "must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission."
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_add("BSD-2-Clause-text", ("redistribution", "reproduce"), f"{_CONDITIONS} {_DISCLAIMER}")
_add("BSD-3-Clause-text", ("redistribution", "reproduce", "neither", "endorse"), f"{_CONDITIONS} {_NAMES} {_DISCLAIMER}")

_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}
_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _version, _scope in _VERSIONS.items():
    for _kind, _long in _KINDS.items():
        _add(
            f"CC-{_kind}-{_version}", (_kind.lower(), _long.lower(), _version), f"Licensed under CC {_kind} {_version}.",
            f"This work is licensed under a Creative Commons {_long} {_version} {_scope} License.",
        )

for _id, _name, _keys, _what, _version, _sign in (
    ("GPL-2.0", "General", ("general", "public", "2"), "program", "2", ";"),
    ("GPL-3.0", "General", ("general", "public", "3"), "program", "3", ":"),
    ("LGPL-2.1", "Lesser General", ("lesser", "2.1"), "library", "2.1", ";"),
    ("LGPL-3.0", "Lesser General", ("lesser", "3"), "library", "3", ":"),
    ("AGPL-3.0", "Affero General", ("affero", "3"), "program", "3", ":"),
):
    _add(
        _id, _keys, f"This work is licensed under the GNU {_name} Public License, version {_version}.",
        f"This {_what} is free software{_sign} you can redistribute it and/or modify it under the terms of the GNU {_name} Public License as published by the Free Software Foundation, "
        f"either version {_version} of the License, or (at your option) any later version.",
    )

for _id in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC0-1.0", "Unlicense", "WTFPL"):
    _add(_id, (_id.lower(),), f"SPDX-License-Identifier: {_id}")
for _id in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
    for _end in ("", "-only", "-or-later"):
        _add(_id, (f"{_id}{_end}".lower(),), f"SPDX-License-Identifier: {_id}{_end}")
