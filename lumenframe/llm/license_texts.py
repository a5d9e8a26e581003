"""Names and notices of well-known licences, and sentences that only sound like them.

Fixed values: the names and the wording of public licence notices.
"""

#: Names by which texts call a licence.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0", "Affero GPL", "AGPL version 3"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0", "Apache License 2.0", "Apache 2 license", "ASL 2.0"),
    "boost": ("Boost Software License", "BSL-1.0", "Boost Software License 1.0"),
    "bsd": ("BSD License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "2-clause BSD license", "new BSD license", "simplified BSD license", "BSD 3-Clause License"),
    "cc-by": ("CC BY", "CC BY 4.0", "CC-BY-3.0", "CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-ND 4.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons BY-SA license"),
    "cc-by-nc": ("CC BY-NC", "CC BY-NC 3.0", "CC BY-NC-SA", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-SA-3.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    "eclipse": ("Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0", "EPL 1.0"),
    "gpl": ("GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0-or-later", "GPL version 2", "GPL v2 or later", "GNU GPL v3", "GNU General Public License version 2", "GNU General Public License v3.0"),
    "isc": ("ISC License", "ISC license terms", "Internet Systems Consortium license"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL", "LGPLv2.1", "LGPL-3.0", "Lesser GPL", "GNU Library General Public License", "LGPL version 2.1"),
    "mit": ("MIT License", "MIT license terms", "the MIT licence", "Expat License", "MIT/Expat license", "an MIT-style license"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "Mozilla Public License, v. 2.0", "MPL 1.1"),
    "public-domain": ("CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "public domain dedication", "Unlicense", "the Unlicense", "Public Domain Mark 1.0"),
    "zlib": ("zlib License", "zlib/libpng license", "zlib license terms"),
}

#: Sentences that put a work under what is named.
CARRIERS: tuple[str, ...] = (
    "{}", "Licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "License: {}", "SPDX-License-Identifier: {}", "This file is subject to the {}.",
    "The source code is available under the {}.", "Published under {}", "Covered by the {}; see the file LICENSE.", "You may use it under the {}.", "Copyright 2015 the authors, {}", "Made available under the {} by its authors.",
)

NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "You may not use the material for commercial purposes.",
    ),
    "eclipse": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain.",
        "We release these pictures into the public domain.",
        "The author hereby places this text in the public domain.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
}

#: Licences of no family above, by the names that texts call them, and sentences of theirs.
OTHER_NAMES: tuple[str, ...] = (
    "European Union Public Licence", "EUPL", "EUPL-1.2", "EUPL v1.1 or later", "WTFPL", "Do What The F*ck You Want To Public License", "Artistic License", "Artistic License 2.0", "Artistic-2.0", "Perl Artistic License",
    "SIL Open Font License", "SIL OFL 1.1", "OFL-1.1", "Common Development and Distribution License", "CDDL", "CDDL-1.0", "Microsoft Public License", "Ms-PL", "Python Software Foundation License", "PSF license", "PSF-2.0",
    "PHP License", "PHP-3.01", "Ruby License", "Sleepycat License", "Vim License", "OpenSSL License", "LaTeX Project Public License", "LPPL-1.3c", "Academic Free License", "AFL-3.0", "CeCILL", "CeCILL-B", "Beerware",
    "Beerware License", "JSON License", "Unicode License", "Open Software License", "OSL-3.0", "Zope Public License", "ZPL-2.1", "Server Side Public License", "SSPL", "SSPL-1.0", "Business Source License", "BUSL-1.1",
    "Elastic License", "Elastic License 2.0", "Open Database License", "ODbL", "ODbL-1.0", "GNU Free Documentation License", "GFDL", "GFDL-1.3", "Common Public License", "CPL-1.0", "IBM Public License", "Universal Permissive License", "UPL-1.0",
    "Open Government Licence", "Open Government Licence v3.0", "Mulan PSL", "MulanPSL-2.0", "Apple Public Source License", "APSL-2.0", "Reciprocal Public License", "RPL-1.5", "PolyForm Noncommercial License", "NCSA License", "University of Illinois/NCSA Open Source License",
)
OTHER_NOTICES: tuple[str, ...] = (
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL.",
    "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3 of this license or any later version.",
    "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "This software is distributed under an open source license of its own; see the file COPYING for its terms.",
    "Contains public sector information licensed under the Open Government Licence v3.0.",
    "This database is made available under the Open Database License; any rights in individual contents are licensed under the Database Contents License.",
)

#: What is no licence, to be put into the carriers.
NO_LICENSE: tuple[str, ...] = (
    "license of the company", "terms of the contract", "agreement between both parties", "name of the editor", "Crown", "law of the land", "sea", "same roof", "old rules", "proprietary license", "commercial license", "driving license", "fishing license", "liquor license", "marriage license", "television licence", "trade license",
    "license agreement", "terms and conditions of the shop", "state license number 2041", "patent of the inventor", "title of the first edition", "general rules of the public library", "version 3 of the plan", "software of the bank",
)

UNKNOWN: tuple[str, ...] = (
    "The restaurant was licensed to serve wine and beer until midnight.",
    "He lost his driving license after the third offence in two years.",
    "All rights reserved. Copyright by the publisher.",
    "Copyright 2019 by the authors, printed in the city.",
    "The warranty covers parts and labour for twelve months.",
    "A license fee is due on the first day of every year.",
    "You need permission from the owner to enter the building.",
    "The software is licensed for use by one person at a time.",
    "This product is sold under license from the original maker.",
    "The public license office opens at nine.",
    "Ask for permission before you redistribute the photographs.",
    "The general public was not admitted to the hearing on copyright.",
    "Under the terms of the agreement the license may be revoked.",
    "Their version of the story was released in May with a copyright notice.",
    "The fishing license is free of charge for children.",
    "A software license is a contract between its owner and a user.",
    "She studied at the institute and later licensed her patents.",
    "The apache helicopter was built under licence abroad.",
    "The commons is open to the public, and no license is needed.",
    "Warranties of any kind are excluded by this dealer.",
    "Er ging mit seinem Hund in den Park und kam mit einem Ball zurück.",
    "Das Haus mit dem roten Dach steht mit der Kirche am Markt.",
    "Wir fahren mit dem Zug, mit Freunden und mit viel Zeit.",
    "MIT is a university on the river, and MIT students row there.",
    "He took his degree at MIT in 1999 and taught at MIT for years.",
    "The gnu is an antelope of the plains, and so is the eland.",
    "An eclipse of the sun was seen from the island in August.",
    "The new engine gives the car a boost on the hill.",
    "The creative work of the commons society was shown to the general public.",
    "The letters were sent by cc by mistake to the whole office.",
    "The lesser of two evils was chosen by the general assembly.",
    "The museum shows works from the public collection free of charge on Sundays.",
    "Attribution of the painting to the master is not certain.",
    "The Mozilla office moved to another street in the spring.",
    "The material was cut in two, and each part was sold for commercial purposes.",
    "Use of the hall is governed by the rules of the club.",
    "This text was written for the use of students and may not be complete.",
    "Software is distributed to all branches of the bank every month.",
    "The source of the river is in the hills, and the code of the valley is old.",
    "The program is free, and everyone is welcome to use the garden.",
    "In no event will the match be played on a Monday.",
    "The above list is not complete, and the following rules apply.",
    "Persons under the age of twelve are not permitted without their parents.",
    "The documentation of the project was provided by the contributors.",
    "The zero hour came, and the domain of the king was at peace.",
    "Released in the summer, the film was published on disc under another title.",
)
