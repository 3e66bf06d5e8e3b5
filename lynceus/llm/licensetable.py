"""Digests of whole license texts, and the usual one-line notices.

``DIGESTS`` are of the canonical forms (``licenses.canonical``) of the texts in
Debian's /usr/share/common-licenses: each whole file, and the file up to the end
of its terms, without the advice on how to apply them. A copy that differs in a
word (another postal address of the FSF, say) has another digest.
"""

from __future__ import annotations

#: License, Debian's file, part, digest.
DIGESTS: tuple[tuple[str, str, str, str], ...] = (
    ("Apache-2.0", "Apache-2.0", "whole", "890175f2e81dae03626a98e35f6e227b9af3421ef35bfb554592a71ed676eaa9"),
    ("Apache-2.0", "Apache-2.0", "terms", "a07acaafbbd3efc89d910f8dc1c26425d3f82b06862987646e0b48edb9ca7c27"),
    ("Artistic-1.0-Perl", "Artistic", "whole", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("BSD-3-Clause", "BSD", "whole", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("CC0-1.0", "CC0-1.0", "whole", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "GFDL-1.2", "whole", "eb44145e61a1b9d4c59857b35ade590dd721f9324f65a695bc00151202a9ceaa"),
    ("GFDL-1.3", "GFDL-1.3", "whole", "e3265f3e965876b0becfa845beb87ba76dc6d7904e37cddfec926e077f97b43e"),
    ("GPL-1.0", "GPL-1", "whole", "c99c820668a8e870b9ab2d3fde5095f0fc8d8fce7728a0dac7c485018d22649e"),
    ("GPL-1.0", "GPL-1", "terms", "ae5d2ab6f0f0f9507e89deea86ac06bed22205f840c80316d04c2cf1c73f251d"),
    ("GPL-2.0", "GPL-2", "whole", "d1fa61212ae86f10c1b0ea5c8db2b3512d73899ca35873143cc967722492e2b6"),
    ("GPL-2.0", "GPL-2", "terms", "1e95e2d233ff8561dbfd49ec57a5544482a8cc2f9016994498703cf747ecfce1"),
    ("GPL-3.0", "GPL-3", "whole", "c3a61fbd56c67082edc0dbea1af43a9ac92d107b35091e88f929121fccfdad83"),
    ("GPL-3.0", "GPL-3", "terms", "7070b32ed743efe8b6d87440c2d569e09fb7f02087bd1253d2bc36353aeae588"),
    ("LGPL-2.0", "LGPL-2", "whole", "a888d77e6cc8e53e11ee3ed23bccf3baaabdb48b46cd0cd50afaae864da4e6b3"),
    ("LGPL-2.0", "LGPL-2", "terms", "ee00b0b43667799dc552a96dce9a9ff56093ac70d61c154d972f50660201f887"),
    ("LGPL-2.1", "LGPL-2.1", "whole", "f8b1d38ac8ea665fe831af3585b7a2308e9b913f9b67be6f8b9716d7bb485690"),
    ("LGPL-2.1", "LGPL-2.1", "terms", "148e6979390d985bdd83fe6868101f4c9960e9978dac9c2c3175ea129fdad619"),
    ("LGPL-3.0", "LGPL-3", "whole", "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6"),
    ("MPL-1.1", "MPL-1.1", "whole", "fcb2cba825b785de1a33bd916ad66398f014edce433feb6b02135d2de029473b"),
    ("MPL-2.0", "MPL-2.0", "whole", "acb03f59b5e7e7189bee32c878a0ab04a6bb09240d6800300827311b0029de1e"),
)

#: License and the names that notices give it.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "the MIT license (MIT)", "MIT"),
    "ISC": ("the ISC License", "ISC"),
    "Zlib": ("the zlib License", "Zlib"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "the Modified BSD License", "BSD-3-Clause"),
    "BSD": ("the BSD License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache-2.0"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "EPL-1.0": ("the Eclipse Public License, Version 1.0", "the Eclipse Public License 1.0", "EPL-1.0"),
    "EPL-2.0": ("the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0", "EPL-2.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"),
    "Unlicense": ("the Unlicense", "Unlicense"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the CC0 1.0 Universal License", "CC0-1.0"),
    **{
        f"{short}-{n}": (f"the {long}, version {n}", f"the {long}, version {n.removesuffix('.0')}", f"the {long} version {n.removesuffix('.0')}", f"the {long} v{n}", f"the GNU {short} v{n.removesuffix('.0')}", f"the {short}v{n.removesuffix('.0')}", f"{short}-{n}")
        for short, long, versions in (("GPL", "GNU General Public License", ("2.0", "3.0")), ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)))
        for n in versions
    },
    **{
        f"CC-{code}-{n}": (f"CC {code} {n}", f"the CC {code} {n} License", f"a Creative Commons {long} {n} International License", f"the Creative Commons {long} {n} International License") if n == "4.0" else (f"CC {code} {n}", f"a Creative Commons {long} {n} Unported License")
        for code, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
        for n in ("3.0", "4.0")
    },
}

_GNU = [x for x in NAMES if "GPL-" in x]
_OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under", *(f"This {x} is licensed under" for x in ("work", "software", "project", "file", "program", "library", "code")), *(f"This {x} is released under" for x in ("software", "project")))

#: License and one of its notices.
NOTICES: tuple[tuple[str, str], ...] = (
    *((x, f"{opening} {name}.") for x, names in NAMES.items() for name in names for opening in _OPENINGS),
    *((f"{x}-or-later", f"{opening} {name} or {later}.") for x in _GNU for name in NAMES[x] for opening in _OPENINGS for later in ("later", "any later version", "(at your option) any later version")),
    *((x, f"SPDX-License-Identifier: {x}{only}") for x in NAMES for only in (("", "-only") if x in _GNU else ("",))),
    *((f"{x}-or-later", f"SPDX-License-Identifier: {x}-or-later") for x in _GNU),
)
