"""Public licence texts, one paragraph each, with the phrases that a match cannot do without.

Paragraphs rather than whole licences, since names of holders, numbering and left-out clauses
stand between them.
"""

#: Fixed values: (label, text, key phrases).
PARAGRAPHS = (
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense and or sell copies"),
    ),
    (
        "mit",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        ("this permission notice shall be included in all copies or substantial portions",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software", "permission notice appear in all copies"),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistributions of source code must retain the above copyright notice",),
    ),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution",
        ("redistributions in binary form must reproduce the above copyright notice",),
    ),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("nor the names of its contributors may be used to endorse or promote products",),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software",
        ("in no event will the authors be held liable for any damages arising from the use of this software",),
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions",
        ("permission is granted to anyone to use this software for any purpose", "alter it and redistribute it freely"),
    ),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license",
        ("any person or organization obtaining a copy of the software and accompanying documentation",),
    ),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means",
        ("anyone is free to copy modify publish use compile sell or distribute this software",),
    ),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    (
        "apache-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        ("software distributed under the license is distributed on an as is basis", "without warranties or conditions of any kind"),
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("redistribute it and or modify it under the terms of the gnu general public license",),
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details",
        ("distributed in the hope that it will be useful but without any warranty", "see the gnu general public license for more details"),
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation",
        ("under the terms of the gnu lesser general public license",),
    ),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation",
        ("under the terms of the gnu affero general public license",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("subject to the terms of the mozilla public license v 2 0",),
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        ("under the terms of the eclipse public license",),
    ),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ("creative commons attribution 4 0 international",),
    ),
    (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ("creative commons attribution sharealike 4 0 international",),
    ),
    (
        "cc-by-nc-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ("creative commons attribution noncommercial 4 0 international",),
    ),
)
