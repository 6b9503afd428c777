"""Wordings of public licenses and of the usual notices that name them: (SPDX id, kind, text). ``<...>`` stands for any few words, or none."""

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD3 = _BSD2 + (
    " Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
    "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_NAMED = [
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License <...> 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU General Public License <...> version 2"), ("GPL-3.0", "GNU General Public License <...> version 3"), ("LGPL-2.1", "GNU Lesser General Public License <...> version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License <...> version 3"), ("AGPL-3.0", "GNU Affero General Public License <...> version 3"), ("MPL-2.0", "Mozilla Public License <...> 2.0"),
    ("ISC", "ISC License"), ("Unlicense", "Unlicense"),
]
_CC = [("CC-BY", "BY", "Attribution"), ("CC-BY-SA", "BY-SA", "Attribution-ShareAlike"), ("CC-BY-NC", "BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND", "BY-ND", "Attribution-NoDerivatives"),
       ("CC-BY-NC-SA", "BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND", "BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
_CC_NAMES = [(f"{spdx}-{v}", name) for v in ("3.0", "4.0") for spdx, short, long in _CC for name in (f"CC {short} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} License {v}", f"Creative Commons {long} License, version {v}")]
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "text", _MIT), ("BSD-2-Clause", "text", _BSD2), ("BSD-3-Clause", "text", _BSD3), ("ISC", "text", _ISC), ("Apache-2.0", "header", _APACHE),
    ("GPL-2.0", "header", _gnu("General Public License", "2")), ("GPL-3.0", "header", _gnu("General Public License", "3")),
    ("LGPL-2.0", "header", _gnu("Library General Public License", "2")), ("LGPL-2.1", "header", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-3.0", "header", _gnu("Lesser General Public License", "3")), ("AGPL-3.0", "header", _gnu("Affero General Public License", "3")),
    ("MPL-2.0", "header", _MPL), ("Unlicense", "text", _UNLICENSE),
    *((spdx, "notice", f"under <...> {name}") for spdx, name in _NAMED),
    *((spdx, "notice", name) for spdx, name in _CC_NAMES),
    ("CC0-1.0", "notice", "CC0 1.0"), ("CC0-1.0", "notice", "Creative Commons Zero <...> 1.0"),
    ("LicenseRef-reserved", "notice", "All rights reserved"),
]
