"""Fixed values of the licence scan: names and paragraphs of licences by family, and texts that belong to none."""

# How licences of each family are called in notices.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0", "ASL 2.0"],
    "bsd": ["BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD license", "simplified BSD license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC 3.0", "CC BY-NC-ND 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0"],
    "gpl": ["GNU General Public License", "GNU General Public License version 2", "GNU General Public License, version 3", "GNU GPL", "GPL", "GPL v2", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0-or-later"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL 2.1", "LGPLv3", "LGPL-2.1-only"],
    "mit": ["MIT", "MIT License", "MIT license (MIT)", "Expat license", "X11 license"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL", "MPL 2.0", "MPL-2.0"],
    "public-domain": ["Unlicense", "CC0 1.0 Universal", "CC0", "Creative Commons Zero", "CC0-1.0"],
}
# Names of licences of no family above.
OTHER_NAMES = ["PostgreSQL License", "Eclipse Public License 2.0", "Academic License 3.0", "Open Software License, Version 3.0", "Python License 2.0", "Ruby License, Version 1.1", "Nethack General License", "W3C Software Notice", "Eclipse Public License", "EPL-2.0", "EUPL", "OpenSSL license", "SIL Open Font License", "Python Software Foundation License", "CDDL", "Zope Public License", "WTFPL", "Ruby license", "Academic Free License", "Microsoft Public License", "Vim license", "same license as the editor", "local dog license", "license of the state"]
# Sentences that name a licence.
FRAMES = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "Code is available under {}.", "SPDX-License-Identifier: {}", "See the {} for details.", "License: {}", "{}"]
# Paragraphs of licences and of the notices they ask for.
PARAGRAPHS = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "If you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "Shared under CC BY-NC-SA 4.0, no commercial use.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 Example Inc. All rights reserved.",
        "(c) 2021 The Example Company, all rights reserved worldwide.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
        "No part of this book may be reproduced, stored in a retrieval system, or transmitted in any form without the prior written permission of the copyright owner.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited; proprietary and confidential.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
}
# Sentences with the words of notices that are none.
OTHERS = [
    "He lost his driving license last year.", "The license plate was not found.", "A fishing license costs ten dollars.", "The office issued a new license to the bar.", "They asked for permission to land.",
    "Permission was granted by the teacher.", "The copyright office opened a new building.", "She wrote a book about copyright law.", "The car is still under warranty.", "A warranty of two years is common here.",
    "All rights and duties pass to the buyer.", "The hotel has reserved all the rooms.", "Seats are reserved for guests.", "Human rights are for all people.", "The public park is open to all.",
    "All rights reserved for members of the club.", "All rights reserved to the crown.", "The rights reserved by the treaty were few.", "The crown reserved all rights to the land.", "He reserved rights of way.",
    "The general public was invited.", "A domain was registered in public.", "Apache helicopters flew over the hills.", "MIT is a university in Cambridge.", "The GNU is an animal of the plains.", "The Apache people lived in the south.",
    "Mozilla released a browser.", "The commons is a field that all villagers may use.", "Creative people work at night.", "Software is sold with a license fee.", "The source of the river is in the north.", "Apache runs the web server.",
    "Poetic license is not a crime.", "The redistribution of land was slow.", "Version 3 of the plan was better.", "No commercial use was found for the plant.", "The terms of the treaty were published.", "He was granted a licence to sell wine.",
    "This licence expires in May.", "The novel fell into the public domain last year.", "The attribution of the painting is in doubt.", "Wealth redistribution was debated.", "Copyright lasts for many years.", "No warranty was given for the old car.",
    "Permission is needed to enter.", "The library is free for all.", "Free software was handed out at the fair.", "They were liable for the damage.", "The contributors met in the hall.", "The patent was filed in time.",
]
# Wordings that are not trained on, to set how sure the scores are; unknown ones are of other licences or of none.
HELD = [
    ("agpl", "the server is AGPL licensed"), ("agpl", "Terms: GNU Affero GPL 3"), ("apache", "Source files are under Apache License 2.0"), ("apache", "available under the Apache Software License"), ("bsd", "you may use it under the BSD license"),
    ("bsd", "BSD licensed code"), ("cc-by", "Images: Creative Commons Attribution 3.0"), ("cc-by", "published under CC BY 2.0"), ("cc-by-nc", "photo under CC BY-NC 2.0"), ("cc-by-nc", "Creative Commons Attribution Noncommercial"),
    ("cc-by-sa", "text under CC BY-SA 2.5"), ("cc-by-sa", "Creative Commons Attribution Share-Alike CC BY-SA"), ("gpl", "covered by the GNU General Public License version 3"), ("gpl", "you can use it under GPL v3"), ("lgpl", "the library is under LGPL v3"),
    ("lgpl", "terms of the GNU Lesser GPL"), ("mit", "This file is distributed under the MIT license"), ("mit", "Permission is hereby granted to any person obtaining a copy of the Software"), ("mpl", "under MPL version 1.1"), ("mpl", "subject to the Mozilla Public License"),
    ("proprietary", "Copyright Someone 1999, all rights reserved."), ("proprietary", "(c) A. Person. All rights reserved"), ("public-domain", "the author has waived all copyright"), ("public-domain", "dedicated under CC0"),
    ("unknown", "Licensed under the Universal Permissive License."), ("unknown", "Released under the NCSA license"), ("unknown", "SPDX-License-Identifier: OFL-1.1"), ("unknown", "This is the Sleepycat license."), ("unknown", "Distributed under the Q Public License."),
    ("unknown", "License: Beerware"), ("unknown", "a taxi license and a permit"), ("unknown", "the permission of the owner is needed"), ("unknown", "all rights reserved to the founders"), ("unknown", "copyright was discussed at length"),
    ("unknown", "the public library and its general rules"), ("unknown", "no warranty for used goods"), ("unknown", "the common people and the apache"), ("unknown", "version 2 of the report"),
]
# Words without which nothing is a notice of a family; "mit" is a common German word and counts in pairs only.
KEYS = """affero agpl agplv3 apache asl attribution bsd cc cc0 commons confidential copyleft copyright creativecommons derivative disclaimer expat gnu gpl gplv2 gplv3 lgpl lgplv3 licence licenced licences license licensed
licenses licensing merchantability mozilla mpl noncommercial noninfringement patent permission permissions permitted prohibited proprietary redistribute redistribution redistributions reproduced reserved sharealike spdx
sublicense unencumbered unlicense waived warranties warranty x11""".split()
KEY_PAIRS = ["public domain", "under mit", "identifier mit", "license mit", "the mit", "mit licensed", "dedicated under", "corresponding source", "anyone is", "copy modify", "general public"]
