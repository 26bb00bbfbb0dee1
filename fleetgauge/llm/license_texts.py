"""Customary headers, titles, openings, short statements and SPDX tags of licenses, by name."""

from __future__ import annotations

_GNU = {"GPL": ("GNU General Public License", {"1": "", "2": "June 1991", "3": "29 June 2007"}),
        "LGPL-library": ("GNU Library General Public License", {"2": "June 1991"}),
        "LGPL": ("GNU Lesser General Public License", {"2.1": "February 1999", "3": "29 June 2007"}),
        "AGPL": ("GNU Affero General Public License", {"3": "19 November 2007"}),
        "GFDL": ("GNU Free Documentation License", {"1.2": "November 2002", "1.3": "3 November 2008"})}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
       "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_KINDS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
_TAGS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause
    BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0
    CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0
    GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only
    LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OSL-3.0
    PostgreSQL PSF-2.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
_SHORT = ("BSD", "ISC", "MIT")

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
    the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
    from this software without specific prior written permission."""
_BSD_AD = """All advertising materials mentioning features or use of this software must display the following acknowledgement: This product
    includes software developed by the organization."""
_BSD_END = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties"


def _listed(*clauses: str) -> tuple[str, str]:
    """An opening, its clauses and an end, without and with numbers."""
    head, *middle, end = clauses
    return " ".join(clauses), " ".join([head, *(f"{i}. {c}" for i, c in enumerate(middle, 1)), end])


def _gnu() -> dict[str, str]:
    out = {}
    for family, (name, versions) in _GNU.items():
        for v, date in versions.items():
            key = f"{family}-{v if '.' in v else v + '.0'}"
            out[f"{key}-title"] = f"{name} Version {v}, {date}"
            out[f"{key}-short"] = f"Licensed under the {name} version {v}"
            if family != "LGPL-library":
                out[f"{key}-abbreviated"] = f"Licensed under the GNU {family} version {v}"
                out[f"{key}-v"] = f"Licensed under the {family}v{v}"
            out[f"{key}-work"] = f"This work is licensed under the {name}, version {v}."
            if family == "GFDL":
                out[f"{key}-header"] = f"""Permission is granted to copy, distribute and/or modify this document under the terms of the {name},
                    Version {v} or any later version published by the Free Software Foundation"""
                continue
            head = f"This program is free software: you can redistribute it and/or modify it under the terms of the {name}"
            out[f"{key}-or-later-header"] = f"""{head} as published by the Free Software Foundation, either version {v} of the License, or
                (at your option) any later version."""
            out[f"{key}-only-header"] = f"{head} as published by the Free Software Foundation, version {v} of the License."
            out[f"{key}-only-header-2"] = f"{head} version {v} as published by the Free Software Foundation."
    return out


def _creative_commons() -> dict[str, str]:
    out = {}
    for mark, name in _CC.items():
        for v, kind in _CC_KINDS.items():
            out[f"CC-{mark}-{v}-short"] = f"Licensed under CC {mark} {v}."
            out[f"CC-{mark}-{v}-tag"] = f"Licensed under CC-{mark}-{v}."
            if "-" in mark:
                out[f"CC-{mark}-{v}-spaced"] = f"Licensed under CC {mark.replace('-', ' ')} {v}."
            out[f"CC-{mark}-{v}-statement"] = f"This work is licensed under a Creative Commons {name} {v} {kind} License."
    return out


_BSD2, _BSD2_NUMBERED = _listed(_BSD, _BSD_1, _BSD_2, _BSD_END)
_BSD3, _BSD3_NUMBERED = _listed(_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_END)
_BSD4, _BSD4_NUMBERED = _listed(_BSD, _BSD_1, _BSD_2, _BSD_AD, _BSD_3, _BSD_END)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"

_TEXTS = {
    "0BSD-text": f"{_ISC}. The software is provided \"as is\" and the author disclaims all warranties",
    "AFL-3.0": "Licensed under the Academic Free License version 3.0",
    "Apache-1.1-text": "The Apache Software License, Version 1.1",
    "Apache-2.0-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0-license": "Licensed under the Apache License 2.0.",
    "Apache-2.0-name": "Licensed under the Apache 2.0 License.",
    "Artistic-1.0-text": """The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright
        Holder maintains some semblance of artistic control over the development of the package""",
    "Apache-2.0-asf": "Licensed to the Apache Software Foundation under one or more contributor license agreements.",
    "Artistic-2.0": "This is free software; you may distribute it under the terms of the Artistic License 2.0.",
    "Artistic-2.0-title": "The Artistic License 2.0",
    "BSD-2-Clause-short": "Licensed under the BSD 2-Clause License.",
    "BSD-2-Clause-text": _BSD2,
    "BSD-2-Clause-text-numbered": _BSD2_NUMBERED,
    "BSD-3-Clause-short": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-text": _BSD3,
    "BSD-3-Clause-text-numbered": _BSD3_NUMBERED,
    "BSD-4-Clause-text": _BSD4,
    "BSD-4-Clause-text-numbered": _BSD4_NUMBERED,
    "BSD-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "BSL-1.0-text": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software""",
    "CC0-1.0": "Licensed under CC0 1.0 Universal",
    "CC0-1.0-title": "Creative Commons Legal Code CC0 1.0 Universal",
    "CC0-1.0-header": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
    "CDDL-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "EPL-1.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which
        accompanies this distribution""",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-v": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2",
    "ISC-text": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-project": "This project is licensed under the MIT License",
    "MIT-style": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "MPL-1.1-title": "Mozilla Public License Version 1.1",
    "MPL-1.1": """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file
        except in compliance with the License.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "MPL-2.0-title": "Mozilla Public License Version 2.0",
    "OFL-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "PostgreSQL-text": """Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and
        without a written agreement is hereby granted""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "Zlib-text": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions:""",
}

CUSTOMARY = {
    **{f"{x}-licensed": f"Licensed under the {x} License." for x in _SHORT},
    **{f"{x}-released": f"Released under the {x} License." for x in _SHORT},
    **{f"{x}-spdx": f"SPDX-License-Identifier: {x}" for x in _TAGS},
    **_gnu(), **_creative_commons(), **_TEXTS,
}
