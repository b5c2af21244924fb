"""Notices and whole texts of licences, by SPDX name, that ``license_scan`` compares besides its statements.

Notices are the headers that the licences tell authors to put on files. Whole texts lie in ``licenses/``, without
copyright lines; the driver reads them.
"""

from __future__ import annotations

from pathlib import Path

_FREE = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free Software Foundation, "
    "either version {2} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {1} for more details. "
    "You should have received a copy of the {1} along with {0}. If not, see <https://www.gnu.org/licenses/>."
)
_WORK = (
    "This work is licensed under the Creative Commons {0} 4.0 International License. To view a copy of this license, visit "
    "http://creativecommons.org/licenses/{1}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."
)
_MAIL = "You should have received a copy of the {0} along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."

NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for "
        "additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you "
        "may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations "
        "under the License.",
    ],
    "CC-BY-4.0": [_WORK.format("Attribution", "by")],
    "CC-BY-NC-4.0": [_WORK.format("Attribution-NonCommercial", "by-nc")],
    "CC-BY-SA-4.0": [_WORK.format("Attribution-ShareAlike", "by-sa")],
    "CC0-1.0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public "
        "domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with "
        "this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>."
    ],
    "GPL-2.0": [_FREE.format("This program", "GNU General Public License", "2").rpartition(" You should")[0] + " " + _MAIL.format("GNU General Public License"), _FREE.format("This program", "GNU General Public License", "2")],
    "GPL-3.0": [_FREE.format("This program", "GNU General Public License", "3")],
    "LGPL-2.1": [_FREE.format("This library", "GNU Lesser General Public License", "2.1").rpartition(" You should")[0] + " " + _MAIL.format("GNU Lesser General Public License"), _FREE.format("This library", "GNU Lesser General Public License", "2.1")],
    "LGPL-3.0": [_FREE.format("This library", "GNU Lesser General Public License", "3")],
    "MIT": ["Licensed under the MIT License. See License.txt in the project root for license information."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/."
    ],
}


def whole_texts() -> dict[str, str]:
    return {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}
