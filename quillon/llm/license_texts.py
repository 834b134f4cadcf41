"""Texts of public licences that the scan knows, by family. Fixed values, as the licences' publishers word them; years and holders are left out."""

#: Names by which notices call a licence.
NAMES = {
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License", "Perl Artistic License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "3-clause BSD license"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License"],
    "CC-BY": ["Creative Commons Attribution License"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial License"],
    "CC-BY-NC-ND": ["Creative Commons Attribution-NonCommercial-NoDerivatives License"],
    "CC-BY-NC-SA": ["Creative Commons Attribution-NonCommercial-ShareAlike License"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives License"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero", "CC0 Public Domain Dedication"],
    "CDDL": ["Common Development and Distribution License", "CDDL"],
    "EPL-2.0": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0"],
    "EUPL": ["European Union Public Licence", "EUPL"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL version 2", "GPL version 3"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPLv2.1", "LGPLv3"],
    "MIT": ["MIT License", "Expat License", "MIT/Expat License"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License", "MPL 2.0"],
    "MS-PL": ["Microsoft Public License", "Ms-PL"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License", "Open Font License"],
    "PostgreSQL": ["PostgreSQL License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "UPL-1.0": ["Universal Permissive License", "Universal Permissive License v 1.0"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "X11": ["X11 License", "X Consortium License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
}

#: Short forms of the Creative Commons families, to which a version is added, and the versions.
CC_SHORT = {"CC-BY": "CC BY", "CC-BY-NC": "CC BY-NC", "CC-BY-NC-ND": "CC BY-NC-ND", "CC-BY-NC-SA": "CC BY-NC-SA", "CC-BY-ND": "CC BY-ND", "CC-BY-SA": "CC BY-SA"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Identifiers behind the tag SPDX-License-Identifier.
SPDX = {
    "0BSD": ["0BSD"], "AGPL": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "Apache-2.0": ["Apache-2.0"], "Artistic-2.0": ["Artistic-2.0"], "BSD-2-Clause": ["BSD-2-Clause"],
    "BSD-3-Clause": ["BSD-3-Clause"], "BSL-1.0": ["BSL-1.0"], "CC-BY": ["CC-BY-3.0", "CC-BY-4.0"], "CC-BY-NC": ["CC-BY-NC-3.0", "CC-BY-NC-4.0"], "CC-BY-NC-ND": ["CC-BY-NC-ND-4.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA-3.0", "CC-BY-NC-SA-4.0"], "CC-BY-ND": ["CC-BY-ND-4.0"], "CC-BY-SA": ["CC-BY-SA-3.0", "CC-BY-SA-4.0"], "CC0-1.0": ["CC0-1.0"], "CDDL": ["CDDL-1.0", "CDDL-1.1"],
    "EPL-2.0": ["EPL-1.0", "EPL-2.0"], "EUPL": ["EUPL-1.1", "EUPL-1.2"], "GPL": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "ISC": ["ISC"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"], "MIT": ["MIT"], "MPL-2.0": ["MPL-1.1", "MPL-2.0"], "MS-PL": ["MS-PL"], "OFL-1.1": ["OFL-1.1"],
    "PostgreSQL": ["PostgreSQL"], "Unlicense": ["Unlicense"], "UPL-1.0": ["UPL-1.0"], "WTFPL": ["WTFPL"], "X11": ["X11"], "Zlib": ["Zlib"],
}

_AS_IS_MIT = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AS_IS_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_AS_IS_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD_GRANT = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'


def _gnu(name: str, thing: str, version: str) -> list[str]:
    return [f'{thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either {version} of the License, or (at your option) any later version.',
            f'{thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.',
            f'You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.',
            f'You should have received a copy of the {name} along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.']


def _cc(name: str) -> list[str]:
    return [f"This work is licensed under a Creative Commons {name} {v} {w} License." for v, w in (("4.0", "International"), ("3.0", "Unported"))] + [
        f"To view a copy of the Creative Commons {name} License, visit http://creativecommons.org/licenses/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


#: Paragraphs of licence texts and of the notices that they ask for. A paragraph that several families share stands with the commonest.
PARAGRAPHS = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL": [*_gnu("GNU Affero General Public License", "This program", "version 3"),
             "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
             "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
                   'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
                   'Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
                   'Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.'],
    "Artistic-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
                     "You are permitted to use the Standard Version and create and use Modified Versions for any purpose without restriction, provided that you do not Distribute the Modified Version."],
    "BSD-2-Clause": [_BSD_GRANT, _AS_IS_BSD],
    "BSD-3-Clause": [_BSD_GRANT + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSL-1.0": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
                "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY": _cc("Attribution"), "CC-BY-NC": _cc("Attribution-NonCommercial"), "CC-BY-NC-ND": _cc("Attribution-NonCommercial-NoDerivatives"), "CC-BY-NC-SA": _cc("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-ND": _cc("Attribution-NoDerivatives"), "CC-BY-SA": _cc("Attribution-ShareAlike"),
    "CC0-1.0": ["To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
                "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/"],
    "CDDL": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.',
             "When distributing Covered Code, include this CDDL HEADER in each file and include the License file. If applicable, add the following below this CDDL HEADER, with the fields enclosed by brackets replaced with your own identifying information."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL": ["Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); you may not use this work except in compliance with the Licence."],
    "GPL": [*_gnu("GNU General Public License", "This program", "version 3"), *_gnu("GNU General Public License", "This program", "version 2"),
            "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works.",
            "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", _AS_IS_ISC],
    "LGPL": [*_gnu("GNU Lesser General Public License", "This library", "version 2.1"), *_gnu("GNU Lesser General Public License", "This library", "version 3"),
             "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "MIT": [_MIT_GRANT, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _AS_IS_MIT],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
                "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"],
    "MS-PL": ["This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software.",
              "This source is subject to the Microsoft Public License (Ms-PL)."],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at https://openfontlicense.org",
                "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software, subject to the following conditions:"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
                   "IN NO EVENT SHALL THE UNIVERSITY BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
                  "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."],
    "UPL-1.0": ["Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software, associated documentation and/or data (collectively the Software), free of charge and under any and all copyright rights in the Software, and any and all patent rights owned or freely licensable by each licensor hereunder."],
    "WTFPL": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION. You just DO WHAT THE FUCK YOU WANT TO.",
              "This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar."],
    "X11": ["Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
             "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
             "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "Proprietary": ["Copyright holder. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
                    "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
                    "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement you entered into.",
                    "Copyright by the authors. All rights reserved."],
}

#: Families whose text is also part of another's: where a document has both, only the other counts.
PART_OF = {"0BSD": "ISC", "BSD-2-Clause": "BSD-3-Clause", "MIT": "X11"}

#: Phrases that are a notice only if they are the whole of it.
WHOLE = {"Proprietary": ["All rights reserved"]}

#: Frames of one-line notices.
FRAMES = ["Released under the {}", "Licensed under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}", "Available under {}", "License: {}", "{}"]

#: Prose that names licences without granting one: class ``none``.
PROSE = [
    "He showed the officer his driving license and the papers of the car.", "The restaurant lost its license to sell wine last year.", "All rights reserved seats were sold out before noon.", "We compared open licenses in a paper on software law.",
    "The city council will license new taxis from May.", "Poets have the license to break the rules of grammar.", "Her permission was never granted and the matter was dropped.", "Conditions were met and the redistribution of land began.",
    "The warranty on the washing machine is limited to two years.", "A public debate about copyright and fair use followed.", "The general public was not admitted to the hearing.", "The foundation gives free software courses to teachers.",
    "Prose about licences, notices and rights is not itself a notice.", "The fishing license costs forty euros a season.", "Nothing in the contract mentions damages or liability.", "The commons behind the church is open to all.",
    "Students of MIT released a report on energy.", "An apache helicopter landed near the village.", "The zero on the licence plate was hard to read.", "The boost in sales came from the new version of the book.",
    "The eclipse was seen by the public in the whole of Europe.", "Artistic freedom needs no license, she said.", "The mozilla mascot stood at the door of the public library.", "The table reserved for us was taken, and our rights were ignored.",
    "This license plate frame is sold without screws.", "Use of the pool is subject to the following hours.", "The authors describe how a licence is chosen for a project and which questions are often asked.", "Please read the terms of the agreement with your landlord.",
    "The provided software course is free of charge to any person of the town.", "A copy of the letter was published without the author's permission.",
]

#: Licences that the families do not include: what calibration must call unknown.
UNLISTED = [
    "The Software shall be used for Good, not Evil.", "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "You may not provide the software to third parties as a hosted or managed service, where the service provides users with access to any substantial set of the features or functionality of the software.",
    "Licensed under the Business Source License; use in production requires a commercial license from the Licensor until the Change Date.", "This product may be used by members of the cooperative under the house rules license in its current form.",
    "Licensed under the Server Side Public License, version 1, which requires the Service Source Code to be made available.", "The data may be used for research only; any commercial use needs a signed agreement with the institute.",
    "Redistributions of any form whatsoever must retain the following acknowledgment: this product includes software developed by the project for use in the toolkit.", "You can use these sounds in your own games and films if you name the studio; selling them alone is forbidden by this sound license.",
    "Use of this model is governed by a community license agreement and an acceptable use policy.", "Licensed under the Sleepycat License, which asks that source code of applications accompany each copy.", "This file may be copied under the terms of the Vim charityware license by those who help needy children.",
    "Permission is granted to members of the club to copy these notes for private study.", "The map may be printed under the town's open map licence if the source is named.", "Released under the Fair Source License with a limit of twenty five users.", "Licensed under the Hippocratic License, which forbids uses that harm human rights.",
    "Distributed under the terms of the Ruby library license of the group.", "You are free to perform this play in schools without fee; other theatres write to the agent.", "Released under the Kepler Community License, version 7.", "Licensed under the Orchard Shared Source terms, revision 12.",
]
