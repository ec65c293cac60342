"""License texts and notices as templates: (label, markup).

``[[ ... ]]`` is an optional region (regions nest), ``{{n}}`` a replaceable one of at most n words, and
``{{a|b c}}`` one of several wordings. Everything else is mandatory. Case and punctuation do not count.
Wording as published by the licenses' stewards.
"""

_BSD_START = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: [[{{1|a|i}}]] Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. [[{{2|b|ii}}]] Redistributions in binary form
    must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """
    [[{{3|c|iii}}]] Neither the name of {{12}} nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. """
_BSD_END = """
    THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
    {{12}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
    BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
    INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""

LICENSE_TEMPLATES = [
    (
        "mit",
        """[[[[The]] MIT License [[(MIT)]] [[Copyright {{30}}]]]] Permission is hereby granted, free of charge, to any
        person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        [[(including the next paragraph)]] shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND [[NON]] {{INFRINGEMENT|NONINFRINGEMENT}}.
        IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
    ),
    ("mit", "{{licensed|released|distributed|available|published}} under [[the terms of]] [[the]] MIT [[open source]] {{license|licence}}"),
    ("mit", "SPDX-License-Identifier: MIT"),
    (
        "isc",
        """Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND {{12}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    ("bsd-2", _BSD_START + _BSD_END),
    ("bsd-3", _BSD_START + _BSD_NAMES + _BSD_END),
    ("bsd-2", "under [[the terms of]] the {{BSD 2 Clause|2 clause BSD|simplified BSD|FreeBSD}} {{license|licence}}"),
    ("bsd-3", "under [[the terms of]] the {{BSD 3 Clause|3 clause BSD|new BSD|revised BSD|modified BSD}} {{license|licence}}"),
    ("bsd-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at {{10}} Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    ("apache-2", "{{licensed|released|distributed|available|published}} under [[the terms of]] [[the]] Apache {{2|license 2|licence 2|license v2|license version 2|licence version 2}} [[0]]"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-2", "under [[the terms of]] [[the]] {{GNU General Public License|GNU GPL|GPL}} {{version 2|v2|2}} [[0]]"),
    ("gpl-3", "under [[the terms of]] [[the]] {{GNU General Public License|GNU GPL|GPL}} {{version 3|v3|3}} [[0]]"),
    ("lgpl-2.1", "under [[the terms of]] [[the]] {{GNU Lesser General Public License|GNU LGPL|LGPL}} {{version 2|v2|2}} 1"),
    ("lgpl-3", "under [[the terms of]] [[the]] {{GNU Lesser General Public License|GNU LGPL|LGPL}} {{version 3|v3|3}} [[0]]"),
    ("agpl-3", "under [[the terms of]] [[the]] {{GNU Affero General Public License|GNU AGPL|AGPL}} {{version 3|v3|3}} [[0]]"),
    ("gpl-2", "This {{3}} is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; [[either]] version 2 of the License"),
    ("gpl-3", "This {{3}} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, [[either]] version 3 of the License"),
    ("lgpl-2.1", "This {{3}} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; [[either]] version 2.1 of the License"),
    ("lgpl-3", "This {{3}} is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, [[either]] version 3 of the License"),
    ("agpl-3", "This {{3}} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, [[either]] version 3 of the License"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0 [[{{only|or later}}]]"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0 [[{{only|or later}}]]"),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at {{10}}""",
    ),
    ("mpl-2", "under [[the terms of]] [[the]] {{Mozilla Public License|MPL}} {{version 2|v 2|v2|2}} [[0]]"),
    ("epl-2", "under [[the terms of]] [[the]] {{Eclipse Public License|EPL}} {{version 2|v 2|v2|2}} [[0]]"),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product
        documentation would be appreciated but is not required. [[2.]] Altered source versions must be plainly marked as
        such, and must not be misrepresented as being the original software. [[3.]] This notice may not be removed or
        altered from any source distribution.""",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
        for any purpose, commercial or non-commercial, and by any means.""",
    ),
    ("cc0", "{{CC0 1|Creative Commons Zero v1|Creative Commons CC0 1}} 0 [[Universal]]"),
    ("cc-by", "under [[the terms of]] [[{{a|the}}]] {{CC BY|Creative Commons Attribution}} {{2|3|4}} {{0|5}} [[{{International|Unported}}]] [[{{license|licence}}]]"),
    ("cc-by-sa", "{{CC BY SA|Creative Commons Attribution ShareAlike|Creative Commons Attribution Share Alike}} [[{{2|3|4}} {{0|5}}]]"),
    ("cc-by-nd", "{{CC BY ND|Creative Commons Attribution NoDerivatives|Creative Commons Attribution NoDerivs}} [[{{2|3|4}} {{0|5}}]]"),
    ("cc-by-nc", "{{CC BY NC|Creative Commons Attribution NonCommercial|Creative Commons Attribution Non Commercial}} [[{{2|3|4}} {{0|5}}]]"),
    ("cc-by-nc-sa", "{{CC BY NC SA|Creative Commons Attribution NonCommercial ShareAlike}} [[{{2|3|4}} {{0|5}}]]"),
    ("cc-by-nc-nd", "{{CC BY NC ND|Creative Commons Attribution NonCommercial NoDerivatives}} [[{{2|3|4}} {{0|5}}]]"),
]
