"""Training text of the licence scan: public licence wording by family, other licence text, and text that is no licence.

Paragraphs are separated by blank lines.
"""

# Customary notices and paragraphs of public licences, by family.
FAMILIES = {
    "AGPL": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.

You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.

The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.

GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007

Licensed under the GNU Affero General Public License v3.

Released under the AGPL v3.

SPDX-License-Identifier: AGPL-3.0-or-later

SPDX-License-Identifier: AGPL-3.0-only
""",
    "Apache-2.0": """
Licensed under the Apache License, Version 2.0.

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.

See the License for the specific language governing permissions and limitations under the License.

Apache License Version 2.0, January 2004

TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.

Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.

Trademarks. This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor, except as required for reasonable and customary use in describing the origin of the Work and reproducing the content of the NOTICE file.

Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. The ASF licenses this file to You under the Apache License, Version 2.0.

This project is released under the Apache 2.0 license.

Apache License 2.0

SPDX-License-Identifier: Apache-2.0
""",
    "BSD": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.

IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.

Licensed under the 3-clause BSD License.

Licensed under the BSD license.

BSD 3-Clause License

BSD 2-Clause License

Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.

SPDX-License-Identifier: BSD-3-Clause

SPDX-License-Identifier: BSD-2-Clause
""",
    "BSL-1.0": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

Distributed under the Boost Software License, Version 1.0.

Boost Software License - Version 1.0 - August 17th, 2003

SPDX-License-Identifier: BSL-1.0
""",
    "CC-BY": """
This work is licensed under a Creative Commons Attribution 4.0 International License.

Licensed under CC BY 4.0.

Content is available under the CC BY 4.0 license.

Creative Commons Attribution 4.0 International Public License

You are free to share and adapt the material for any purpose, even commercially, under the following terms: you must give appropriate credit, provide a link to the license, and indicate if changes were made.

SPDX-License-Identifier: CC-BY-4.0
""",
    "CC-BY-NC": """
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.

Licensed under CC BY-NC 4.0.

Content is available under the CC BY-NC 4.0 license for noncommercial use.

Creative Commons Attribution-NonCommercial 4.0 International Public License

NonCommercial: you may not use the material for commercial purposes.

SPDX-License-Identifier: CC-BY-NC-4.0
""",
    "CC-BY-SA": """
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.

Licensed under CC BY-SA 4.0.

Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.

Creative Commons Attribution-ShareAlike 4.0 International Public License

ShareAlike: if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.

SPDX-License-Identifier: CC-BY-SA-4.0
""",
    "CC0": """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.

Released under CC0 1.0 Universal public domain dedication.

Creative Commons CC0 1.0 Universal

The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.

SPDX-License-Identifier: CC0-1.0
""",
    "GPL": """
This work is licensed under the GNU General Public License, version 3.

This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.

The GNU General Public License is a free, copyleft license for software and other kinds of works.

GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007

GNU GENERAL PUBLIC LICENSE Version 2, June 1991

Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.

Released under the GNU GPL v3 or later.

Licensed under the GPLv2.

SPDX-License-Identifier: GPL-3.0-or-later

SPDX-License-Identifier: GPL-3.0-only

SPDX-License-Identifier: GPL-2.0-only

SPDX-License-Identifier: GPL-2.0-or-later
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.

IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.

Licensed under the ISC license.

ISC License

SPDX-License-Identifier: ISC
""",
    "LGPL": """
This library is licensed under the GNU Lesser General Public License, version 2.1.

This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.

You can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.

GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007

Released under the GNU LGPL v3.

SPDX-License-Identifier: LGPL-2.1-or-later

SPDX-License-Identifier: LGPL-3.0-only
""",
    "MIT": """
Released under the MIT License.

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.

IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

Licensed under the MIT license.

The MIT License (MIT)

MIT License

SPDX-License-Identifier: MIT
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.

If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.

Licensed under the Mozilla Public License, version 2.0.

Mozilla Public License Version 2.0

This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.

SPDX-License-Identifier: MPL-2.0
""",
    "Unlicense": """
This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.

For more information, please refer to <https://unlicense.org>

SPDX-License-Identifier: Unlicense
""",
    "Zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

This notice may not be removed or altered from any source distribution.

SPDX-License-Identifier: Zlib
""",
}
# What the families are called, and sentences that name a licence.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license", "Apache License"],
    "BSD": ["BSD License", "3-clause BSD License", "BSD 3-Clause License", "2-clause BSD License", "BSD-style license", "New BSD License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License 1.0"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0 license", "CC BY 4.0", "CC BY 3.0", "CC-BY license"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0 license", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC license"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0 license", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA license"],
    "CC0": ["Creative Commons CC0", "CC0 1.0 Universal", "CC0 license", "CC0 1.0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPLv2", "GPL license"],
    "ISC": ["ISC License"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU LGPL", "LGPLv3", "LGPLv2.1", "LGPL license"],
    "MIT": ["MIT License", "MIT licence", "MIT-style license", "Expat License"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense", "Unlicense license"],
    "Zlib": ["zlib License", "zlib/libpng license"],
}
STRANGERS = ["Eclipse Public License", "Common Development and Distribution License", "European Union Public Licence", "Artistic License", "WTFPL", "Microsoft Public License", "SIL Open Font License", "proprietary license"]
FRAMES = ["{}", "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "This project is licensed under the {}.", "It is available under the {}."]

# Licence text of none of these families.
UNKNOWN = """
All rights reserved.

All rights reserved. No part of this publication may be reproduced without permission.

All rights reserved. No part of this work may be reproduced, stored in a retrieval system, or transmitted in any form or by any means without the prior written permission of the publisher.

Use of this software is subject to the terms of the end user license agreement.

Licensed under a proprietary license; redistribution is not permitted.

Copyright the authors. All rights reserved.

Redistribution requires written permission of the copyright holder.

This software is licensed, not sold, under the terms of the accompanying license agreement.

This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.

The contents of this file are subject to the terms of the Common Development and Distribution License.

Licensed under the European Union Public Licence, version 1.2.

You may use this package under the terms of the Artistic License 2.0.

SPDX-License-Identifier: EPL-2.0

SPDX-License-Identifier: LicenseRef-Proprietary

By installing the product you accept the licence terms and may not reverse engineer, decompile or disassemble it.

The licensee shall not sublicense, rent or lease the software to third parties.

This material is confidential and proprietary; unauthorized copying or redistribution is prohibited.

Source code is licensed for internal use only and may not be redistributed.

Copyright notice: reproduction of this document in whole or in part requires the written consent of the owner.
"""
# Text that is no licence, much of it with words that licences use.
OTHER = """
A driver's license is required to rent a car.

The public library is open to the general public from nine to five.

The company was licensed by the city to sell food at the market.

She studied at MIT before she joined the foundation.

Er kam mit dem Zug und ging mit ihr.

The apache helicopter is operated by the army.

This work is free and open to any person.

Released in March, the film was a commercial success.

The source of the river is in the mountains.

Use of this form is subject to the following conditions: it must be signed and returned.

The agreement grants permission to use the software for free.

The general met the public in the city.

Their software was distributed on paper tape with the documentation, and programs were copied by hand.

The court ruled that the warranty covered the damages and that the seller was liable for the loss.

In no event was the claim against the contractor settled before the end of the year.

The author granted an interview about the book, its copyright history and the rights to the film.

You must include the following information: the name of the product, its version, and the date of purchase.

The above list shows the names of the contributors to the conference and the conditions of the prize.

Without limitation of time, any person may apply for a copy of the document, provided that the fee is paid.

He wrote the original version of the program, and others modified and merged it.

The binary star is visible without a telescope, in either form of the catalogue.

Freedom of the press, in the words of the foundation's founder, is a public good.

The boost in sales was followed by a new version of the product.

The creative director left; the commons voted on the bill at noon.

The attribution of the painting to the master is disputed.

Please refer to the manual for more information on the purpose of each part.

Der Bibliotheksausweis ist kostenlos; alle Rechte und Pflichten stehen in der Satzung.

Le permis de conduire est obligatoire pour louer une voiture, sans exception.

La licencia de obras fue concedida por el ayuntamiento en marzo.

Les droits de l'auteur sont inscrits dans la loi.

The terms of the treaty were published, and each party was free to withdraw.

The distribution of income under the new law is either fair or not, depending on the source.

It is distributed in the hope of reaching readers who find it useful.

The software industry changed: code was no longer given away, and licences were sold.

The museum's collection may be used by students for any purpose, even at night.

Copy the list, sort it by name, and publish the result at the end of the month.

The fitness centre opened for a particular group of members at no charge.

The implied meaning of the phrase is lost in the translation.

She was held liable for the damage to the car, which was provided by the company as is.

The mozilla was a fictional lizard in the story.
"""
# Common English words, which tell nothing of a text's kind.
COMMON = frozenset(
    "a about above after again against all along also although am an and another any anyone are around as at away be because been before being below between both but by can cannot could did do does doing done down during each "
    "either else even ever every few first for from further get given go good had has have having he her here hers him his how however i if in into is it its itself just kind kinds last later least less let like made make many may "
    "me means might more most much must my name near neither never new next no nor not now of off often old on once one only onto or other others otherwise our out over own part people place please possible rather said same say see "
    "set several shall she should since so some someone something still such take than that the their them then there these they thing this those though three through thus time to together too toward two under unless until up upon us "
    "use used using very was way we well were what when where whether which while who whole whom whose why will with within without work works world would write written year yes yet you your".split()
)


def paragraphs(text: str) -> list[str]:
    return [" ".join(p.split()) for p in text.split("\n\n") if p.strip()]


NOTICES = {family: paragraphs(text) for family, text in FAMILIES.items()}
UNKNOWN_NOTICES, OTHER_TEXTS = paragraphs(UNKNOWN), paragraphs(OTHER)


def framed(names: list[str]) -> list[str]:
    """Each name in each sentence; a name of one word doesn't stand alone."""
    return [f.format(name) for name in names for f in FRAMES if f != "{}" or " " in name]


#: Sentences that name the licences of each family, and others.
NAMED = {family: framed(names) for family, names in NAMES.items()}
NAMED_UNKNOWN = framed(STRANGERS)
