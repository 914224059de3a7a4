"""Short notices and characteristic passages of public licences, by family."""

from __future__ import annotations

_SPDX = "SPDX-License-Identifier: {}"

TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License. See the LICENSE file in the project root.",
        "Distributed under the terms of the MIT license.",
        _SPDX.format("MIT"),
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        _SPDX.format("Apache-2.0"),
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2 or later.",
        _SPDX.format("GPL-3.0-or-later"),
        _SPDX.format("GPL-2.0-only"),
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        _SPDX.format("LGPL-2.1-or-later"),
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License.",
        _SPDX.format("AGPL-3.0-only"),
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        _SPDX.format("BSD-3-Clause"),
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "Licensed under the Mozilla Public License, version 2.0.",
        _SPDX.format("MPL-2.0"),
    ),
    "isc": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        _SPDX.format("ISC"),
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution NonCommercial, no commercial use of this text without permission.",
        _SPDX.format("CC-BY-NC-4.0"),
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        _SPDX.format("CC-BY-SA-4.0"),
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        _SPDX.format("CC-BY-4.0"),
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide.",
        "Released under CC0 1.0 Universal, public domain dedication.",
        _SPDX.format("CC0-1.0"),
        _SPDX.format("Unlicense"),
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
        "Copyright. All rights reserved.",
    ),
}

#: Sentences that share words with licences but are none.
BACKGROUND = (
    "The driver lost his license after the second offence and had to take the bus.",
    "She asked for permission to leave the room and the teacher granted it.",
    "The public library is free of charge and open to any person in the city.",
    "The new version of the software was released in the spring by the publisher.",
    "General practitioners must renew their medical license every five years.",
    "The copy of the letter was published in the local newspaper without restriction.",
    "We distribute the work among the members of the team under these conditions.",
    "The source of the river lies in the mountains, and use of the water is limited by law.",
    "A modified form of the engine was sold in 1998 with a two year warranty.",
    "The apache helicopter landed near the base while the crew waited.",
    "The foundation gave money to the school for a creative arts program.",
    "Students at MIT built a robot that can walk under water.",
    "Attribution of the painting to the master is still debated by experts.",
    "In the domain of physics the law of gravity is universal.",
    "Terms such as these are used in documentation, files and notices.",
    "The rights of workers were discussed in the commons until midnight.",
)

FUNCTION_WORDS = (
    "a the of and to in is it that for on with as was at by be this from are or an have not you but they which all "
    "with from their there been were will would can has had its if so no who what when one "
    "le la de et les des un une du en dans que qui par pour sur au ou est il elle on "
    "der die das und ist von zu mit den im ein eine nicht auf für als auch "
    "el la los de y en un una que por con para del se su al"
).split()
