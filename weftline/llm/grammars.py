"""Lexers and grammars of Python, JavaScript, TypeScript, Java, Go and Rust, written for this package from the languages'
public definitions. They judge syntax only: names and types need not resolve."""

from __future__ import annotations

import re
from functools import lru_cache

from weftline.llm.peg import EOF, ERR, NL, Grammar, Units

#: File suffix, in any case, to the grammar that judges it.
SUFFIXES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust"}

#: Stands for an element of a JSX or TSX text, once that is known to be well formed.
ELEMENT = "\ue0fe"
#: File suffixes whose texts may hold elements.
WITH_ELEMENTS = [".jsx", ".tsx"]

PY_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
JS_WORDS = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with"
JS_SOFT = "async await from get let of set static yield as"
TS_SOFT = "abstract asserts declare enum implements infer interface is keyof module namespace override private protected public readonly satisfies type unique"
JAVA_WORDS = "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true false try void volatile while"
JAVA_SOFT = "record sealed permits yield non var when"
GO_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
RUST_WORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while"
RUST_SOFT = "union auto macro_rules raw default"

PYTHON = r"""
Line      <- Simple / Header Simple?
Simple    <- Small (";" Small)* ";"?
Small     <- "pass" / "break" / "continue" / "return" List? / "raise" (Test ("from" Test)?)? / "global" Names / "nonlocal" Names
           / "del" TList / "assert" Test ("," Test)? / Import / "type" IDENT @Subscript? "=" Test / Expr
Names     <- Name ("," Name)*
Name      <- IDENT / "match" / "case" / "type"
Import    <- "import" AsPath ("," AsPath)* / "from" ("." / "...")* Path? "import" ("*" / @Imports / AsName ("," AsName)*)
Path      <- Name ("." Name)*
AsPath    <- Path ("as" Name)?
AsName    <- Name ("as" Name)?
Imports   <- AsName ("," AsName)* ","?
Value     <- Yield / List
Yield     <- "yield" ("from" Test / List)?
Expr      <- One ":" Test ("=" Value)? / One AUG Value / (TList "=")* Value
One       <- Atom (Trailer &Trailer)* ("." Name / @Subscript) !Trailer / Name !Trailer / @Single !Trailer
Single    <- One
TList     <- STarget ("," STarget)* ","?
STarget   <- "*"? Target
Target    <- Atom (Trailer &Trailer)* ("." Name / @Subscript) !Trailer / Name !Trailer / @Targets !Trailer / @TargetList !Trailer
Targets   <- TList?
TargetList <- TList?
Trailer   <- "." Name / @Args / @Subscript
List      <- Star ("," Star)* ","?
Star      <- "*" Bin / Named
Named     <- Name ":=" Test / Test
Test      <- Lambda / Bin ("if" Bin "else" Test)?
Lambda    <- "lambda" (LParam ("," LParam)* ","?)? ":" Test
LParam    <- "*" Name? / "**" Name / "/" / Name ("=" Test)?
Bin       <- Un (BINOP Un / "*" Un / "**" Un / "/" Un / "not" "in" Un / "is" "not"? Un / "in" Un / "and" Un / "or" Un)*
Un        <- ("not" / UNOP / "await")* Post
Post      <- Atom ("." Name / @Args / @Subscript)*
Atom      <- STR+ / Name / NUM / "None" / "True" / "False" / "..." / @Paren / @Listing / @Braces
Paren     <- (Yield / Star For+ / List)?
Listing   <- (Star For+ / List)?
Braces    <- (Pair For+ / Pair ("," Pair)* ","? / Star For+ / List)?
Pair      <- "**" Bin / Test ":" Test
For       <- "async"? "for" TList "in" Bin ("if" (Name ":=" Bin / Lambda / Bin))*
Args      <- Named For+ / (First ("," First)* ("," Second)* ("," Third)* ","? / Second ("," Second)* ("," Third)* ","? / Third ("," Third)* ","?)?
First     <- "*" Test / !(Name "=") Named
Second    <- "*" Test / Name "=" Test
Third     <- "**" Test / Name "=" Test
Subscript <- Slice ("," Slice)* ","?
Slice     <- Test? ":" Test? (":" Test?)? / Star
Params    <- (Param ("," Param)* ","?)?
Param     <- "*" (Name (":" Star)?)? / "**" Name (":" Test)? / "/" / Name (":" Test)? ("=" Test)?
Header    <- If / Elif / Else / Loop / Try / Except / Finally / With / Def / Class / Match / Case
If        <- "if" Named ":"
Elif      <- "elif" Named ":"
Else      <- "else" ":"
Loop      <- "while" Named ":" / "async"? "for" TList "in" List ":"
Try       <- "try" ":"
Except    <- "except" "*"? (List ("as" Name)?)? ":"
Finally   <- "finally" ":"
With      <- "async"? "with" (@WithItems ":" / WithItem ("," WithItem)* ":")
WithItem  <- Test ("as" STarget)?
WithItems <- WithItem ("," WithItem)* ","?
Def       <- "async"? "def" Name @Subscript? @Params ("->" List)? ":"
Class     <- "class" Name @Subscript? @Args? ":"
Match     <- "match" List ":"
Case      <- "case" CaseList ("if" Named)? ":"
CaseList  <- CaseItem ("," CaseItem)* ","?
CaseItem  <- "*"? Test ("as" Name)?
Decorator <- "@" Named
"""
#: Classes of logical lines; a capital stands for a header with its statement on the same line.
PY_BLOCK = r"""
File   <- Body?
Block  <- Body
Body   <- Stmt+
Stmt   <- "s" / If / Loop / Try / "w" @Block / "W" / Deco* ("d" @Block / "D") / Switch
Deco   <- "@"
If     <- ("i" @Block / "I") ("e" @Block / "E")* Else?
Else   <- "l" @Block / "L"
Loop   <- ("f" @Block / "F") Else?
Try    <- ("t" @Block / "T") (("x" @Block / "X")+ Else? Finally? / Finally)
Finally <- "y" @Block / "Y"
Switch <- "m" @Cases
Cases  <- ("k" @Block / "K")+
"""

JS = r"""
File      <- Item*
Block     <- Item*
Item      <- ";" / NL / Stmt
End       <- ";" / NL / !.
Name      <- IDENT / SOFT
Key       <- IDENT / SOFT / WORD
Prop      <- Key / STR / NUM / PRIVATE / @Computed
Stmt      <- @Block / Var End / If / For / While / Do / Try / Switch / Import / Export / "async"? "function" "*"? Name FuncTail / Decos Class
           / "return" Seq? End / "throw" Seq End / ("break" / "continue") Name? End / "debugger" End / "with" @Seq Body / TsStmt
           / Name ":" Stmt / !"function" !"class" Seq End
Var       <- ("var" / "let" / "const") Bind ("," Bind)*
Bind      <- Target "!"? Ann? ("=" Assign)?
Target    <- Name / @Object / @Array
Body      <- NL? (";" / Stmt)
If        <- "if" @Seq Body (NL? "else" Body)?
For       <- "for" "await"? @ForHead Body
ForHead   <- (("var" / "let" / "const") Target Ann? / Post) ("of" Assign / "in" Seq) / (Var / Seq)? ";" Seq? ";" Seq?
While     <- "while" @Seq Body
Do        <- "do" Body NL? "while" @Seq End?
Try       <- "try" @Block NL? ("catch" @CatchParam? @Block (NL? "finally" @Block)? / "finally" @Block)
CatchParam <- Target Ann?
Switch    <- "switch" @Seq @Cases
Cases     <- NL* (("case" Seq / "default") ":" Item*)*
Import    <- "import" (STR / TsType? ((Name ("," (@Names / "*" "as" Name))? / @Names / "*" "as" Name) "from" STR)) End / TsImport
Names     <- (Named ("," Named)* ","?)?
Named     <- TsType &(Key / STR) Rename / Rename
Rename    <- (Key / STR) ("as" (Key / STR))?
Export    <- "export" ("default" ("async"? "function" "*"? Name? FuncTail / Decos Class / Assign End) / "*" ("as" Key)? "from" STR End
           / TsType? @Names ("from" STR)? End / Var End / "async"? "function" "*"? Name FuncTail / Decos Class / TsStmt / TsExport)
Seq       <- Assign ("," Assign)*
Assign    <- Arrow / "yield" ("*"? Assign)? / Cond (ASSIGN Assign)?
Arrow     <- "async"? (Name / TypeParams? @Params Ret?) "=>" (@Block / Assign)
Cond      <- Bin ("?" Assign ":" Assign)?
Bin       <- Un (BINOP Un / ">" ">"? ">"? "="? Un / "in" Un / "instanceof" Un / Cast)*
Un        <- (UNOP / "++" / "--" / "typeof" / "void" / "delete" / "await" &(Name / "this" / "new" / "super" / "import" / STR / @Paren / @Array / "function"))* Post
Post      <- Prim Suffix* ("++" / "--")?
Suffix    <- "." (Key / PRIVATE) / "?." (Key / PRIVATE / @Args / @Seq1 / TEMPLATE) / @Args / @Seq1 / TEMPLATE / TsSuffix
Prim      <- "async"? "function" "*"? Name? FuncTail / Decos Class / "new" New / Name / NUM / STR / TEMPLATE / REGEX / "this" / "super" / "null" / "true"
           / "false" / @Array / @Object / @Paren / "import" ("." Key / @Args) / PRIVATE / JSX
New       <- "." Key / ("new" New / "this" / "super" / Name / @Paren / "function" "*"? Name? FuncTail / Decos Class / "import" "." Key) ("." (Key / PRIVATE) / @Seq1 / TEMPLATE)* TypeArgs? @Args?
Paren     <- Seq
Seq1      <- Seq
Computed  <- Assign
Args      <- (("..."? Assign) ("," "..."? Assign)* ","?)?
Array     <- ","* ("..."? Assign (","+ "..."? Assign)* ","*)?
Object    <- (Member ("," Member)* ","?)?
Member    <- "..." Assign / (("get" / "set" / "async" / "*") &(Prop / "*"))* Prop TypeParams? @Params Ret? @Block / Prop ":" Assign / Name ("=" Assign)?
FuncTail  <- TypeParams? @Params Ret? (@Block / TsNoBody)
Params    <- (Param ("," Param)* ","?)?
Param     <- Decos TsMods ("..."? Target / "this") TsOpt? Ann? ("=" Assign)?
Decos     <- ("@" Name ("." Key)* @Args? NL?)*
Class     <- "class" Name? TypeParams? ("extends" Post TypeArgs?)? TsImpl? @ClassBody
ClassBody <- (";" / NL / ClassItem)*
ClassItem <- Decos Mods (Prop TsOpt? TypeParams? @Params Ret? (@Block / TsNoBody) / "static" @Block / TsIndex / Prop TsOpt? "!"? Ann? ("=" Assign)? (";" / NL / !.))
Mods      <- (("static" / "async" / "get" / "set" / "*" / TsMod) &(Prop / "*"))*
"""
JS_ONLY = r"""
TsType <- NEVER
Ann <- NEVER
Ret <- NEVER
TypeParams <- NEVER
TypeArgs <- NEVER
TsStmt <- NEVER
TsExport <- NEVER
TsImport <- NEVER
TsSuffix <- NEVER
TsNoBody <- NEVER
TsMods <- NEVER*
TsMod <- NEVER
TsOpt <- NEVER
TsImpl <- NEVER
TsIndex <- NEVER
Cast <- NEVER
"""
TS_ONLY = r"""
TsType    <- "type"
Ann       <- ":" Type
Ret       <- ":" ("asserts"? (Name / "this") "is" Type / "asserts" (Name / "this") / Type)
TypeParams <- "<" TypeParam ("," TypeParam)* ","? ">"
TypeParam <- ("in" / "out" / "const")* Name ("extends" Type)? ("=" Type)?
TypeArgs  <- "<" Type ("," Type)* ">"
TsStmt    <- "interface" Name TypeParams? ("extends" TypeList)? @TypeBody / "type" Name TypeParams? "=" Type End / "const"? "enum" Name @EnumBody
           / "declare" ("global" @Block / Stmt) / ("namespace" / "module") (STR / Name ("." Name)*) @Block / "abstract" Class
TsExport  <- "=" Assign End / "as" "namespace" Name End
TsImport  <- "import" Name "=" Seq End
TsSuffix  <- "!" !"=" / TypeArgs &(@Args / TEMPLATE)
TsNoBody  <- End
TsMods    <- (("public" / "private" / "protected" / "readonly" / "override") &(Name / @Object / @Array))*
TsMod     <- "public" / "private" / "protected" / "readonly" / "abstract" / "override" / "declare"
TsOpt     <- "?" / "!"
TsImpl    <- "implements" TypeList
TsIndex   <- @IndexSig Ann (";" / NL / !.)
Cast      <- ("as" / "satisfies") ("const" / Type)
TypeList  <- TypeRef ("," TypeRef)*
TypeRef   <- Name ("." Key)* TypeArgs?
Type      <- Union ("extends" Union "?" Type ":" Type)?
Union     <- "|"? Inter ("|" Inter)*
Inter     <- "&"? Postfix ("&" Postfix)*
Postfix   <- PrimType (@EmptyIdx / @TypeIdx)*
PrimType  <- FuncType / ("keyof" / "unique" / "readonly" / "infer") Postfix / "typeof" ("import" @Args / Name) ("." Key)* TypeArgs? / "import" @Args ("." Key)* TypeArgs?
           / TypeRef / STR / NUM / "-" NUM / TEMPLATE / "void" / "null" / "this" / "true" / "false" / @TypeBody / @Tuple / @TypeParen
FuncType  <- "abstract"? "new"? TypeParams? @Params "=>" ("asserts"? (Name / "this") "is" Type / Type)
TypeParen <- Type
EmptyIdx  <- !.
TypeIdx   <- Type
Tuple     <- (Elem ("," Elem)* ","?)?
Elem      <- "..."? (Name "?"? ":" Type / Type "?"?)
IndexSig  <- Name ":" Type / Name "in" Type ("as" Type)?
TypeBody  <- (TypeItem (";" / "," / NL)* / ";" / NL)*
TypeItem  <- (("readonly" / "+" / "-" / "get" / "set") &(Prop / @IndexSig / "readonly"))* (Prop "?"? TypeParams? @Params Ret? / "new"? TypeParams? @Params Ret? / @IndexSig (("+" / "-")? "?")? Ann? / Prop "?"? Ann?)
EnumBody  <- (Prop ("=" Assign)? ("," Prop ("=" Assign)?)* ","?)?
"""

JAVA = r"""
File      <- (Annot* "package" QName ";")? (Import / ";")* (TypeDecl / ";")*
Import    <- "import" "static"? QName ("." "*")? ";"
QName     <- Name ("." Name)*
Name      <- IDENT / SOFT
Annot     <- "@" QName @AnnotArgs? !"interface"
AnnotArgs <- (Name "=" AnnotVal ("," Name "=" AnnotVal)* / AnnotVal)?
AnnotVal  <- Annot / @AnnotList / Tern
AnnotList <- (AnnotVal ("," AnnotVal)* ","?)?
Mod       <- Annot / "public" / "protected" / "private" / "static" / "abstract" / "final" / "native" / "synchronized" / "transient" / "volatile" / "strictfp" / "default" !":" / "sealed" / "non" "-" "sealed"
TypeDecl  <- Mod* TypeDef
TypeDef   <- "class" Name TypeParams? ("extends" Type)? ("implements" Types)? ("permits" Types)? @ClassBody
           / "@"? "interface" Name TypeParams? ("extends" Types)? ("permits" Types)? @ClassBody
           / "enum" Name ("implements" Types)? @EnumBody
           / "record" Name TypeParams? @Params ("implements" Types)? @ClassBody
Types     <- Type ("," Type)*
TypeParams <- "<" TypeParam ("," TypeParam)* ">"
TypeParam <- Annot* Name ("extends" Type ("&" Type)*)?
Prim      <- "boolean" / "byte" / "short" / "int" / "long" / "char" / "float" / "double"
Type      <- Annot* (Prim / Named) (Annot* @Empty)*
Named     <- Name TypeArgs? ("." Annot* Name TypeArgs?)*
TypeArgs  <- "<" (TypeArg ("," TypeArg)*)? ">"
TypeArg   <- Annot* "?" (("extends" / "super") Type)? / Type
Empty     <- !.
ClassBody <- (";" / "static"? @Block / ClassItem)*
ClassItem <- Mod* (TypeDef / TypeParams? Mod* (Name @Params Throws? @Block / ("void" / Type) Name @Params @Empty* Throws? (@Block / "default" AnnotVal ";" / ";") / Name @Block / Type Vars ";"))
Throws    <- "throws" Types
EnumBody  <- (Const ("," Const)* ","?)? (";" ClassBody)?
Const     <- Annot* Name @Args? @ClassBody?
Params    <- (Param ("," Param)* )?
Param     <- ("final" / Annot)* Type Annot* ("..." )? (Name "." )? (Name / "this") @Empty*
Vars      <- Var ("," Var)*
Var       <- Name @Empty* ("=" (@ArrayInit / Expr))?
ArrayInit <- ((@ArrayInit / Expr) ("," (@ArrayInit / Expr))* ","?)?
Block     <- Stmt* ExprOnly?
ExprOnly  <- NEVER
Stmt      <- ";" / @Block / ("final" / Annot)* Type Vars ";" / Ctl / Mod* TypeDef / Name ":" Stmt / Effect ";"
Ctl       <- "if" @Cond Stmt ("else" Stmt)? / "while" @Cond Stmt / "do" Stmt "while" @Cond ";" / "for" @ForHead Stmt / "switch" @Cond @Cases
           / "try" @Resources? @Block ("catch" @CatchParam @Block)* ("finally" @Block)? / "return" Expr? ";" / "throw" Expr ";" / "break" Name? ";"
           / "continue" Name? ";" / "synchronized" @Cond @Block / "assert" Expr (":" Expr)? ";" / "yield" Expr ";"
Effect    <- Expr
Cond      <- Expr
ForHead   <- ("final" / Annot)* Type Name ":" Expr / (("final" / Annot)* Type Vars / Exprs)? ";" Expr? ";" Exprs?
Exprs     <- Expr ("," Expr)*
Resources <- Resource (";" Resource)* ";"?
Resource  <- ("final" / Annot)* Type Name "=" Expr / Post
CatchParam <- ("final" / Annot)* Type ("|" Type)* Name
Cases     <- (("case" CaseItem ("," CaseItem)* / "default") ("when" Expr)? (":" Stmt* / "->" (@Block / "throw" Expr ";" / Expr ";")))*
CaseItem  <- "default" / ("final" / Annot)* Type (Name / @Patterns Name?) / Tern
Patterns  <- (Pattern ("," Pattern)*)?
Pattern   <- Type (Name / @Patterns Name?)
Expr      <- Lambda / Tern (ASSIGN Expr / ">" ">" ">"? "=" Expr)?
Lambda    <- (Name / @LambdaParams) "->" (@Block / Expr)
LambdaParams <- (Name ("," Name)* / Params)?
Tern      <- Bin ("?" (Lambda / Tern) ":" (Lambda / Tern))?
Bin       <- Un ("instanceof" "final"? Type (@Patterns Name? / Name)? / BINOP Un / ">" ">"? ">"? "="? Un)*
Un        <- ("+" / "-" / "++" / "--" / "!" / "~")* (@CastType &(Lambda / Name / STR / NUM / "this" / "new" / "super" / "!" / "~" / @Paren / "null" / "true" / "false" / "switch") (Lambda / Un) / @PrimCast Un / Post)
CastType  <- Type ("&" Type)*
PrimCast  <- Prim
Post      <- Atom Suffix* ("++" / "--")?
Suffix    <- "." (TypeArgs? (Name / "super") / "new" Creator / "this" / "class") / @Args / @Index / "::" TypeArgs? (Name / "new")
Atom      <- Named (@Empty+ ("." "class" / "::" "new") / &"::") / Name / NUM / STR / "true" / "false" / "null" / "this" / "super" / @Paren / "new" Creator / (Prim / "void") @Empty* ("." "class" / "::" "new") / "switch" @Cond @Cases
Creator   <- TypeArgs? Annot* (Prim / Named) (@Args @ClassBody? / @Empty+ @ArrayInit / @Index+ @Empty*)
Paren     <- Expr
Args      <- Exprs?
Index     <- Expr
"""

GO = r"""
File      <- "package" IDENT ";" (Import ";")* (Top ";")* Top?
Import    <- "import" (Spec / @Imports)
Imports   <- (Spec? ";")* Spec?
Spec      <- ("." / IDENT)? STR
Top       <- "func" @Params IDENT @Params Result? @Block? / "func" IDENT @TypeParams? @Params Result? @Block? / Decl
Decl      <- "var" (@VarList / VarSpec) / "const" (@VarList / VarSpec) / "type" (@TypeList / TypeSpec)
VarList   <- (VarSpec? ";")* VarSpec?
VarSpec   <- Idents (Type ("=" Exprs)? / "=" Exprs)?
TypeList  <- (TypeSpec? ";")* TypeSpec?
TypeSpec  <- IDENT @TypeParams "="? Type / IDENT "="? Type
TypeParams <- IDENT ("," IDENT)* Constraint ("," IDENT ("," IDENT)* Constraint)* ","?
Constraint <- "~"? Type ("|" "~"? Type)*
Idents    <- IDENT ("," IDENT)*
Params    <- (Param ("," Param)* ","?)?
Param     <- IDENT "..."? Type / "..."? Type
Result    <- Type / @Params
Type      <- "func" @Params Result? / "map" @TypeIn Type / "chan" "<-"? Type / "<-" "chan" Type / "struct" @Struct / "interface" @Iface / "*" Type / @Empty Type / @Length Type / @TypeIn / IDENT ("." IDENT)? @TypeArgs?
TypeIn    <- Type
TypeArgs  <- Type ("," Type)* ","?
Empty     <- !.
Length    <- "..." / Expr
Struct    <- (Field? ";")* Field?
Field     <- (Idents Type / "*"? IDENT ("." IDENT)? @TypeArgs?) STR?
Iface     <- (IfaceItem? ";")* IfaceItem?
IfaceItem <- IDENT @Params Result? / Constraint
Block     <- (Stmt? ";")* Stmt?
Stmts     <- (Stmt? ";")*
Stmt      <- Decl / If / For / Switch / "select" @Cases / "return" Exprs? / ("go" / "defer") Expr / ("break" / "continue" / "goto") IDENT? / "fallthrough" / @Block / IDENT ":" ";"? Stmt? / Simple
Simple    <- Exprs (":=" Exprs / "=" Exprs / ASSIGN Expr / "++" / "--" / "<-" Expr)?
HSimple   <- HExprs (":=" HExprs / "=" HExprs / ASSIGN HExpr / "++" / "--" / "<-" HExpr)?
If        <- "if" (HSimple? ";")? HExpr @Block ("else" (If / @Block))?
For       <- "for" ((HExprs (":=" / "="))? "range" HExpr / HSimple? ";" HExpr? ";" HSimple? / HExpr)? @Block
Switch    <- "switch" (HSimple? ";")? HSimple? @Cases
Cases     <- (("case" (Simple / Types) / "default") ":" (Stmt? ";")* (Stmt !.)?)*
Types     <- Type ("," Type)*
Exprs     <- Expr ("," Expr)*
Expr      <- Un (BINOP Un)*
Un        <- UNOP* Post
Post      <- Atom (@Lit)? ("." (IDENT / @Assert) / @Args / @Index / @Lit)*
HExprs    <- HExpr ("," HExpr)*
HExpr     <- HUn (BINOP HUn)*
HUn       <- UNOP* HPost
HPost     <- (&("func" / "map" / "struct" / @Empty / @Length) Atom @Lit / Atom) ("." (IDENT / @Assert) / @Args / @Index)*
Atom      <- NUM / STR / "func" @Params Result? @Block / @Empty Type / @Length Type / "map" @TypeIn Type / "struct" @Struct / "chan" "<-"? Type / "interface" @Iface / "func" @Params Result? / IDENT / @Paren
Assert    <- "type" / Type
Paren     <- Expr / Type
Args      <- (Arg ("," Arg)* "..."? ","?)?
Arg       <- Expr !IDENT / Type
Index     <- Expr? ":" Expr? (":" Expr)? / Expr / TypeArgs
Lit       <- (Elem ("," Elem)* ","?)?
Elem      <- (Expr / @Lit) (":" (Expr / @Lit))?
"""

RUST = r"""
File      <- InnerAttr* Item*
InnerAttr <- "#" "!" @Tokens
Attr      <- "#" @Tokens
Any       <- .*
Tokens    <- .*
Tree      <- .*
Vis       <- "pub" @Path1?
Path1     <- "in" Path / "crate" / "self" / "super"
Name      <- IDENT / SOFT
Item      <- ";" / Attr* Vis? Def / Attr* MacroItem
Def       <- ("const" / "async" / "unsafe" / "extern" STR? / "default")* Fn / "struct" Name Generics? (Where? (@Fields / ";") / @TupleFields Where? ";") / "union" Name Generics? Where? @Fields
           / "enum" Name Generics? Where? @Variants / "unsafe"? "impl" Generics? "!"? Type ("for" Type)? Where? @Impl / "unsafe"? "auto"? "trait" Name Generics? (":" Bounds)? Where? ("=" Bounds ";" / @Impl)
           / "use" UseTree ";" / "unsafe"? "mod" Name (";" / @File) / ("const" / "static" "mut"?) (Name / "_") ":" Type ("=" Expr)? ";" / "type" Name Generics? (":" Bounds)? Where? ("=" Type)? Where? ";"
           / "extern" "crate" (Name / "self") ("as" (Name / "_"))? ";" / "unsafe"? "extern" STR? @Impl / "macro_rules" "!" Name (@Any / @Tree ";" / @Tokens ";")
MacroItem <- Path "!" Name? (@Any / @Tree ";" / @Tokens ";")
UseTree   <- "::"? ("*" / @UseList / Seg ("::" Seg)* ("::" ("*" / @UseList))? ("as" (Name / "_"))?)
UseList   <- (UseTree ("," UseTree)* ","?)?
Seg       <- Name / "self" / "Self" / "super" / "crate"
Path      <- "::"? Seg ("::" Seg)*
Fn        <- "fn" Name Generics? @Params ("->" Type)? Where? (@Block / ";")
Generics  <- "<" (GParam ("," GParam)* ","?)? ">"
GParam    <- Attr* (LIFE (":" (LIFE ("+" LIFE)*)?)? / "const" Name ":" Type ("=" GLit)? / Name (":" Bounds?)? ("=" Type)?)
GLit      <- "-"? (NUM / STR / "true" / "false") / @Block
Where     <- "where" (WhereItem ("," WhereItem)* ","?)?
WhereItem <- LIFE ":" (LIFE ("+" LIFE)*)? / ("for" Generics)? Type ":" Bounds?
Bounds    <- Bound ("+" Bound)* "+"?
Bound     <- LIFE / "?"? ("for" Generics)? TPath / @BoundParen
BoundParen <- Bound
Params    <- (SelfParam ("," Param)* ","? / Param ("," Param)* ","?)?
SelfParam <- Attr* ("&" LIFE?)? "mut"? "self" (":" Type)?
Param     <- Attr* (Pat1 ":" Type / "..." / Type)
Fields    <- (Field ("," Field)* ","?)?
Field     <- Attr* Vis? Name ":" Type ("=" Expr)?
TupleFields <- (Attr* Vis? Type ("," Attr* Vis? Type)* ","?)?
Variants  <- (Variant ("," Variant)* ","?)?
Variant   <- Attr* Vis? Name (@Fields / @TupleFields)? ("=" Expr)?
Impl      <- InnerAttr* (Item / Attr* Vis? "default"? Def)*
Type      <- Type1
Type1     <- ("&" / "&&") LIFE? "mut"? Type1 / "*" ("const" / "mut") Type1 / "dyn" Bounds / "impl" Bounds / ("for" Generics)? ("unsafe" / "extern" STR?)* "fn" @FnTypes ("->" Type1)? / "!" / "_" / @TupleType / @ArrayType / Path "!" (@Any / @Tree / @Tokens) / TPath
FnTypes   <- (FnType ("," FnType)* ","?)?
FnType    <- ((Name / "_") ":")? Type
TupleType <- (Type ("," Type)* ","?)?
ArrayType <- Type (";" Expr)?
TPath     <- "::"? TSeg ("::" TSeg)* / QPath
QPath     <- "<" Type ("as" TPath)? ">" ("::" TSeg)+
TSeg      <- Seg (("::")? GArgs / "::"? @FnTypes ("->" Type)?)?
GArgs     <- "<" (GArg ("," GArg)* ","?)? ">"
GArg      <- LIFE / Name GArgs? "=" Type / Name ":" Bounds / Type / GLit
Block     <- InnerAttr* Stmts Attr* Expr?
Stmts     <- (";" / Let / Attr* Vis? Def / Attr* BlockExpr !("." / "?") ";"? / Attr* Path "!" @Any !("." / "?") ";"? / Attr* Expr ";")*
Let       <- Attr* "let" Pat (":" Type)? ("=" Expr ("else" @Block)?)? ";"
BlockExpr <- (LIFE ":")? ("unsafe"? @Block / "const" @Block / "async" "move"? @Block / If / Match / "loop" @Block / "while" Cond @Block / "for" Pat "in" HExpr @Block)
If        <- "if" Cond @Block ("else" (If / @Block))?
Cond      <- CondItem ("&&" CondItem)*
CondItem  <- "let" Pat "=" HNoAnd / HExpr
HNoAnd    <- HUn (HOP HUn / ">" ">"? "="? HUn / "as" Type)* ((".." / "..=") HNoAnd?)?
Match     <- "match" HExpr @Arms
Arms      <- InnerAttr* (Attr* Pat ("if" Cond0)? "=>" (BlockExpr !("." / "?" / BINOP) ","? / Expr ("," / !.)))*
Cond0     <- Cond0Item ("&&" Cond0Item)*
Cond0Item <- "let" Pat "=" HNoAnd / Expr
Expr      <- "return" Expr? / "break" LIFE? Expr? / "continue" LIFE? / "yield" Expr? / Closure / Range (("=" / ASSIGN / ">" ">" "=") Expr)?
Closure   <- ("static" / "async" / "move")* ("||" / "|" (CParam ("," CParam)* ","?)? "|") ("->" Type @Block / Expr)
CParam    <- Attr* Pat1 (":" Type)?
Range     <- Bin ((".." / "..=") Bin?)? / (".." / "..=") Bin?
Bin       <- Un (BINOP Un / ">" ">"? "="? Un / "as" Type)*
Un        <- ("-" / "!" / "*" / "&" ("raw" &("const" / "mut"))? ("mut" / "const")? / "&&" "mut"?)* (Closure / Post)
Post      <- Atom Suffix*
Suffix    <- "?" / "." (Name ("::" GArgs)? / NUM / "await") / @Args / @Index
Atom      <- NUM / STR / "true" / "false" / BlockExpr / Macro / EPath @StructLit / EPath / @Paren / @Array / "_"
HExpr     <- "return" HExpr? / "break" LIFE? HExpr? / Closure / HRange (("=" / ASSIGN) HExpr)?
HRange    <- HBin ((".." / "..=") HBin?)? / (".." / "..=") HBin?
HBin      <- HUn (BINOP HUn / ">" ">"? "="? HUn / "as" Type)*
HUn       <- ("-" / "!" / "*" / "&" "mut"? / "&&" "mut"?)* (Closure / HAtom Suffix*)
HAtom     <- NUM / STR / "true" / "false" / "unsafe" @Block / If / Match / "loop" @Block / Macro / EPath / @Paren / @Array
Macro     <- Path "!" (@Any / @Tree / @Tokens)
EPath     <- ("::"? ESeg ("::" ESeg)*) / "<" Type ("as" TPath)? ">" ("::" ESeg)+
ESeg      <- Seg ("::" GArgs)?
StructLit <- ((SField ("," SField)* ","?)? (".." Expr?)?)
SField    <- Attr* (Name / NUM) (":" Expr)?
Paren     <- (Expr ("," Expr)* ","?)?
Args      <- (Expr ("," Expr)* ","?)?
Array     <- (Expr (";" Expr / ("," Expr)* ","?))?
Index     <- Expr
Pat       <- "|"? Pat1 ("|" Pat1)*
Pat1      <- ("&" / "&&") "mut"? Pat1 / Lit ((".." / "..=" / "...") (Lit / EPath)?)? / ".." (Lit / EPath)? / "..=" (Lit / EPath) / "_" / Path "!" (@Any / @Tree / @Tokens)
           / "ref"? "mut"? Name !("::" / @StructPat / @TuplePat / ".." / "..=") ("@" Pat1)? / EPath (@StructPat / @TuplePat / (".." / "..=") (Lit / EPath)?)? / @TuplePat / @SlicePat
Lit       <- "-"? (NUM / STR) / "true" / "false"
TuplePat  <- (Pat ("," Pat)* ","?)?
SlicePat  <- (Pat ("," Pat)* ","?)?
StructPat <- (PField ("," PField)* ","?)? (".."? ","?)
PField    <- Attr* ((Name / NUM) ":" Pat / "ref"? "mut"? Name)
"""


def _kinds(words: str, soft: str, ops: str, classes: list[str], **sets: str) -> dict[str, str]:
    """Characters of tokens and classes; ``sets`` name several tokens together."""
    out: dict[str, str] = {}
    for k, tok in enumerate([*words.split(), *soft.split(), *ops.split()]):
        out[tok] = chr(0x400 + k)
    for k, c in enumerate(classes):
        out[c] = chr(0x600 + k)
    out["NL"], out["NEVER"] = NL, "\x02"
    out["SOFT"] = "".join(out[w] for w in soft.split()) or "\x02"
    out["WORD"] = "".join(out[w] for w in words.split())
    for name, toks in sets.items():
        out[name] = "".join(out[t] for t in toks.split())
    return out


class Language:
    """Turns a text into kinds and judges it."""

    def __init__(self, name: str, token: str, grammar: Grammar, flags: int = 0):
        self.name, self.grammar = name, grammar
        self.token = re.compile(token, re.X | re.S | flags)
        self.classify = Units(self.kind_of)

    def kind_of(self, tok: str) -> str:
        raise NotImplementedError

    def tokens(self, text: str) -> list[str]:
        return self.token.findall(text)

    def lay_out(self, kinds: str) -> str:
        return kinds

    def clean(self, text: str) -> str:
        return text.removeprefix("﻿").replace("\r\n", "\n")

    def valid(self, text: str, jsx: bool = False) -> bool:
        classify = self.classify
        text = self.clean(text)
        kinds = "".join([classify[t] for t in self.token.findall(self.without_elements(text) if jsx else text)])
        if ERR in kinds:
            return False
        g = self.grammar
        flat = g.flatten(self.lay_out(kinds))
        return ERR not in flat and g.accepts("File", flat)

    def without_elements(self, text: str) -> str:
        return text

    def failure(self, text: str, jsx: bool = False) -> int:
        """Character offset of the furthest failure of a text that is not valid."""
        clean = self.clean(text)
        kinds, at = [], []
        for m in self.token.finditer(self.without_elements(clean) if jsx else clean):
            k = self.classify[m.group(1)]
            kinds.append(k)
            at += [m.start(1)] * len(k)
        laid, keep = self.lay_out_kept("".join(kinds))
        k = self.grammar.furthest_failure("File", laid)
        return at[keep[k]] if k < len(keep) else len(clean)

    def lay_out_kept(self, kinds: str) -> tuple[str, list[int]]:
        """The laid-out kinds and the place of each in the kinds before."""
        laid = self.lay_out(kinds)
        keep, j = [], 0
        for c in laid:
            while j < len(kinds) and kinds[j] != c and not (kinds[j] == NL and c not in (NL,) and c == self.grammar.kinds.get(";")):
                j += 1
            keep.append(min(j, len(kinds) - 1))
            j += 1
        return laid, keep


NUMBER = {
    "python": r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[1-9](?:_?\d)*|0(?:_?0)*|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][+-]?\d(?:_?\d)*)?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*|\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?[jJ])[jJ]?",
    "javascript": r"(?:0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:0|[1-9][\d_]*)n|(?:(?:0|[1-9][\d_]*)\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)",
    "java": r"(?:0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)",
    "go": r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?",
    "rust": r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?",
}
NUMBER["typescript"] = NUMBER["javascript"]
LONG = r"[^\\\"]*(?:(?:\\.|\"(?!\"\"))[^\\\"]*)*"
LONG1 = r"[^\\']*(?:(?:\\.|'(?!''))[^\\']*)*"
DQ, SQ = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'"

PY_TOKEN = rf"""[ \t\f]*(?:\\\n[ \t\f]*)*(\n[ \t\f]*|\#[^\n]*|(?:[rRbBuUfFtT]{{1,3}}(?=["']))?(?:\"\"\"{LONG}\"\"\"|'''{LONG1}'''|{DQ}|{SQ})|[^\W\d]\w*|\d[\w.]*(?:(?<=[eE])[+-]\d\w*)?|\.\d\w*(?:(?<=[eE])[+-]\d\w*)?
  |->|:=|\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|[-+*/%@&|^=!<>]=|\S|\Z)"""
BRACE = r"""[ \t\f\v\xa0﻿]*(\n[ \t\n]*|//[^\n]*|/\*.*?\*/|{strings}|{word}|{number}|{ops}|\S|\Z)"""
JS_WORD = r"[\#]?[^\W\d][\w$]*|[\#]?\$[\w$]*"
JS_STRINGS = rf"""{DQ}|{SQ}|`[^`\\$]*(?:(?:\\.|\$(?!\{{)|\$\{{[^{{}}`]*(?:(?:\{{[^{{}}]*\}}|`[^`]*`)[^{{}}`]*)*\}})[^`\\$]*)*`"""
#: A slash behind an operand divides and is taken with it; any other slash opens a regular expression.
JS_DIVIDE = r"(?:(?!(?:return|typeof|case|in|of|do|else|void|delete|throw|new|instanceof|yield|await)\b)[^\W\d][\w$]*|\d[\w.]*|\)|\])[ \t]*/(?![/*])=?"
JS_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
JS_OPS = r"\?\?=|\*\*=|&&=|\|\|=|<<=|===|!==|\.\.\.|\?\.(?!\d)|=>|\?\?|\*\*|&&|\|\||\+\+|--|<<|==|!=|<=|[-+*%&|^]="


class Python(Language):
    """Logical lines are judged one by one, then their nesting by indentation."""

    LINE = re.compile("([-])([^-]*)")
    RUNS = re.compile("[-]+(?=[-])")
    INSIDE = re.compile("[-]")

    def __init__(self):
        kinds = _kinds(
            PY_WORDS, "match case type", "( ) ; , . : = := -> * ** / @ ... + - ~ // % & | ^ << >> < > <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **=", ["IDENT", "NUM", "STR"],
            AUG="+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", BINOP="+ - // % @ & | ^ << >> < > <= >= == !=", UNOP="+ - ~",
        )
        g = Grammar(PYTHON, kinds, {"(": ["Args", "Params", "Paren", "Imports", "WithItems", "Targets", "Single"], "[": ["Listing", "Subscript", "TargetList"], "{": ["Braces"]})
        super().__init__("python", PY_TOKEN, g)
        self.kinds, self.number = kinds, re.compile(NUMBER["python"])
        # a group's kinds hold line breaks with their indentation; inside brackets they mean nothing
        mask = g.mask
        g.groups.make = lambda group: mask(self.INSIDE.sub("", group))
        block = {c: c for c in "siIeElLfFtTxXyYwWdDmkK@"}
        self.nest = Grammar(PY_BLOCK, block, {"(": ["Block", "Cases"], "[": [], "{": []})
        self.lines = Units(self.line_class)
        self.headers = [("If", "i"), ("Elif", "e"), ("Else", "l"), ("Loop", "f"), ("Try", "t"), ("Except", "x"), ("Finally", "y"), ("With", "w"), ("Def", "d"), ("Class", "d"), ("Match", "m"), ("Case", "k")]

    def kind_of(self, tok: str) -> str:
        c = tok[:1]
        if c == "\n":
            w = 0
            for x in tok[1:]:
                w = 0 if x == "\f" else (w // 8 + 1) * 8 if x == "\t" else w + 1
            return chr(0xF000 + min(w, 0x7FF))
        if c in ("", "#"):
            return ""
        if tok in self.kinds and tok not in ("IDENT", "NUM", "STR", "AUG", "BINOP", "UNOP", "NL", "NEVER", "SOFT", "WORD", "(", ")"):
            return self.kinds[tok]
        if tok in "()[]{}":
            return tok
        if tok[-1] in "\"'" and len(tok) > 1:
            head = tok[: min(tok.find(q) for q in "\"'" if q in tok)].lower()
            if "f" in head or "t" in head:
                quotes = 3 if tok[len(head) : len(head) + 3] in ('"""', "\'\'\'") and len(tok) - len(head) >= 6 else 1
                return self.kinds["STR"] if self.fields(tok[len(head) + quotes : -quotes]) else ERR
            return self.kinds["STR"]
        if c.isalpha() or c == "_":
            return self.kinds["IDENT"]
        if self.number.fullmatch(tok):
            return self.kinds["NUM"]
        return ERR

    def fields(self, text: str) -> bool:
        """Whether the replacement fields of a formatted string are closed and hold expressions; formats may hold fields again."""
        p = 0
        while p < len(text):
            c = text[p]
            if c in "{}" and text[p : p + 2] == c * 2:
                p += 2
            elif c == "}":
                return False
            elif c == "{":
                depth, q, cut = 0, p + 1, None
                while q < len(text) and (depth or text[q] != "}"):
                    if text[q] in "\"'":
                        end = text.find(text[q], q + 1)
                        if end < 0:
                            return False
                        q = end
                    elif text[q] in "([{":
                        depth += 1
                    elif text[q] in ")]}":
                        depth -= 1
                    elif not depth and cut is None and (text[q] == ":" or text[q] == "!" and text[q + 1 : q + 2] != "="):
                        cut = q
                    q += 1
                if q >= len(text):
                    return False
                body, spec = text[p + 1 : cut or q], text[cut:q] if cut else ""
                if spec.startswith("!"):
                    if not re.match(r"![rsa](?=:|$)", spec):
                        return False
                    spec = spec[2:]
                kinds = "".join([self.classify[t] for t in self.token.findall(re.sub(r"=\s*$", "", body))])
                flat = self.grammar.flatten(self.INSIDE.sub("", kinds))
                if ERR in flat or not self.grammar.match("Value", flat) or not self.fields(spec):
                    return False
                p = q + 1
            else:
                p += 1
        return True

    def line_class(self, line: str) -> str:
        g = self.grammar
        if g.match("Simple", line):
            return "s"
        if g.match("Decorator", line):
            return "@"
        for rule, c in self.headers:
            g.furthest = 0
            end = g.table[rule](line + EOF, 0, {})
            if end == len(line):
                return c
            if end > 0 and c not in "mk" and g.match("Simple", line[end:]):
                return c.upper()
            if end > 0 and c == "k" and g.match("Simple", line[end:]):
                return "K"
        return ERR

    def laid(self, kinds: str) -> tuple[str, int] | None:
        """Nested classes of the lines, or None with a broken line; blocks stand in parentheses."""
        lines = self.lines
        out, stack = [], [0]
        for k, (indent, body) in enumerate(self.LINE.findall(kinds)):
            if not body:
                continue
            w = ord(indent) - 0xF000
            if w != stack[-1]:
                if w > stack[-1]:
                    out.append("(")
                    stack.append(w)
                else:
                    while stack[-1] > w:
                        stack.pop()
                        out.append(")")
                    if stack[-1] != w:
                        return None
            c = lines[body]
            if c == ERR:
                return None
            out.append(c)
        return "".join(out) + ")" * (len(stack) - 1), len(stack)

    def valid(self, text: str, jsx: bool = False) -> bool:
        classify = self.classify
        kinds = "".join([classify[t] for t in self.token.findall("\n" + self.clean(text))])
        if ERR in kinds:
            return False
        flat = self.grammar.flatten(self.RUNS.sub("", kinds))
        if ERR in flat or "(" in flat or "[" in flat or "{" in flat:
            return False
        nested = self.laid(self.RUNS.sub("", flat))
        if nested is None:
            return False
        out = self.nest.flatten(nested[0])
        return self.nest.accepts("File", out)

    def failure(self, text: str, jsx: bool = False) -> int:
        clean = "\n" + self.clean(text)
        kinds, at = [], []
        for m in self.token.finditer(clean):
            k = self.classify[m.group(1)]
            kinds.append(k)
            at += [m.start(1)] * len(k)
        whole = "".join(kinds)
        # logical lines with the place of each of their tokens: brackets are followed by hand
        depth, start, lines, opened = 0, 0, [], []
        for i, c in enumerate(whole):
            if c == ERR:
                return max(0, at[i] - 1)
            if c in "([{":
                opened.append((c, i))
            elif c in ")]}":
                if not opened or {"(": ")", "[": "]", "{": "}"}[opened.pop()[0]] != c:
                    return max(0, at[i] - 1)
            elif "" <= c <= "" and not opened:
                lines.append((start, i))
                start = i
        if opened:
            return len(clean) - 1
        lines.append((start, len(whole)))
        stack, before = [0], "s"
        for a, b in lines:
            body = whole[a + 1 : b] if b > a else ""
            if not body:
                continue
            w = ord(whole[a]) - 0xF000
            flat = self.grammar.flatten(body)
            c = self.lines[flat] if ERR not in flat else ERR
            first = max(0, at[a + 1] - 1)
            if c == ERR:
                return max(first, max(0, at[min(a + 1 + self._far(body, flat), b - 1)] - 1))
            deeper = w > stack[-1]
            if deeper != (before in "ielftxywdmk"):
                return first
            if deeper:
                stack.append(w)
            while stack[-1] > w:
                stack.pop()
            if stack[-1] != w:
                return first
            before = c
        if before in "ielftxywdmk":
            return len(clean) - 1
        return max(0, at[lines[-1][0]] - 1)

    def _far(self, body: str, flat: str) -> int:
        """Furthest failure of a line over its readings, as an index into its tokens."""
        keep = [k for k, c in enumerate(body) if not "" <= c <= ""]
        far = self.grammar.furthest_failure("Line", "".join(body[k] for k in keep))
        return keep[far] if far < len(keep) else len(body) - 1


class Brace(Language):
    """Languages whose blocks stand in braces."""

    def __init__(self, name, words, soft, ops, rules, roles, lined=(), listed=None, strings=DQ, word=r"[^\W\d]\w*", opexp="", glue="", extra=(), **sets):
        self.kinds = _kinds(words, soft, ops, ["IDENT", "NUM", "STR", *extra], **sets)
        self.names = {*words.split(), *soft.split(), *ops.split()}
        g = Grammar(rules, self.kinds, roles, set(lined), listed or {}, "".join(self.kinds[w] for w in glue.split()))
        number = r"\d[\w.]*(?:(?<=[eE])[+-]\d\w*)?|\.\d\w*" if name != "rust" else r"\d\w*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d\w*)?(?:\.(?![\w.]))?"
        super().__init__(name, BRACE.format(strings=strings, word=word, number=number, ops=opexp), g)
        self.number = re.compile(NUMBER[name])

    def kind_of(self, tok: str) -> str:
        c = tok[:1]
        if c == "\n":
            return NL
        if not c or tok.startswith("//"):
            return ""
        if tok.startswith("/*"):
            return NL if "\n" in tok else ""
        if tok in self.names:
            return self.kinds[tok]
        if tok in "()[]{}":
            return tok
        return self.other(tok, c)

    def other(self, tok: str, c: str) -> str:
        if c in "\"'`" and len(tok) > 1 and tok[-1] == c:
            return self.kinds["STR"]
        if c.isalpha() or c in "_$":
            return self.kinds["IDENT"]
        if self.number.fullmatch(tok):
            return self.kinds["NUM"]
        return ERR

    def lay_out(self, kinds: str) -> str:
        return kinds.replace(NL, "")


class Script(Brace):
    """JavaScript and TypeScript: line breaks end statements where the next token cannot continue them."""

    OPS = "; , . : = => ? ?. ... + - * / % ** & | ^ << < > <= == != === !== && || ?? ! ~ ++ -- += -= *= /= %= **= &= |= ^= <<= &&= ||= ??= @"

    def __init__(self, name: str, rules: str, soft: str, roles: dict):
        super().__init__(
            name, JS_WORDS, soft, self.OPS, rules, roles, lined={"Block", "ClassBody", "Cases", "TypeBody"}, listed={"Block": "Block", "File": "File"},
            strings=rf"{JS_STRINGS}|{JS_DIVIDE}|{JS_REGEX}", word=JS_WORD, opexp=JS_OPS, glue="else", extra=["TEMPLATE", "REGEX", "PRIVATE", "JSX"],
            ASSIGN="= += -= *= /= %= **= &= |= ^= <<= &&= ||= ??=", BINOP="+ - * / % ** & | ^ << < <= == != === !== && || ??", UNOP="! ~ + -",
        )
        k = self.kinds
        ender = "".join(k[x] for x in ["IDENT", "NUM", "STR", "TEMPLATE", "REGEX", "PRIVATE", "JSX", "++", "--", *"break continue debugger return this super null true false".split()]) + k["SOFT"] + ")]}"
        starter = "".join(k[x] for x in ["IDENT", "NUM", "STR", "REGEX", "PRIVATE", "++", "--", "!", "~", "@"]) + k["SOFT"] + k["WORD"] + "{}[*"
        starter = "".join(c for c in starter if c not in k["in"] + k["instanceof"])
        self.breaks = re.compile(f"(?<=[{re.escape(ender)}])N+(?=[{re.escape(starter)}])|(N+)")

    def lay_out(self, kinds: str) -> str:
        return self.breaks.sub(lambda m: "" if m.group(1) else NL, kinds)

    def kind_of(self, tok: str) -> str:
        if len(tok) > 1 and tok[0] not in "`/\"'" and tok[-1] in "/=" and "/" in tok[1:]:
            head, eq = tok.rstrip("="), tok.endswith("=")
            return self.kind_of(head[:-1].rstrip()) + self.kinds["/=" if eq else "/"]
        return super().kind_of(tok)

    def other(self, tok: str, c: str) -> str:
        if c == "`":
            if len(tok) < 2 or tok[-1] != "`":
                return ERR
            return self.kinds["TEMPLATE"] if all(self.expression(x) for x in re.findall(r"(?<!\\)\$\{((?:[^{}]|\{[^{}]*\})*)\}", tok)) else ERR
        if c == "/" and len(tok) > 2:
            return self.kinds["REGEX"]
        if c == "#" and len(tok) > 1:
            return self.kinds["PRIVATE"]
        if tok == ELEMENT:
            return self.kinds["JSX"]
        return super().other(tok, c)

    #: Behind these a ``<`` opens an element; behind all else it compares or opens type arguments.
    OPENS = re.compile(r"(?:[=(\[{},;:?!&|+*%^~>-]|=>|\b(?:return|default|yield|case|await|typeof|void|delete|in|of|else|do))\s*\Z|\A\s*\Z")
    TAG = re.compile(r"\s*([A-Za-z_$][\w$-]*(?:[.:][A-Za-z_$][\w$-]*)*)?")
    ATTRIBUTE = re.compile(r"""\s*([A-Za-z_$][\w$-]*(?::[A-Za-z_$][\w$-]*)?)(?:\s*=\s*("[^"]*"|'[^']*'|(?=[{<])))?""")
    GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|=[^>])")
    BLANK = re.compile(r"(?:\s|/\*.*?\*/|//[^\n]*)*", re.S)

    def without_elements(self, text: str) -> str:
        """The text with each well-formed element as one token of the same length, so offsets stay; a broken element is left as it is and fails."""
        if "<" not in text:
            return text
        return self.spliced(text, 0, "")[0]

    def spliced(self, text: str, p: int, closer: str) -> tuple[str, int]:
        """Tokens from ``p`` on with their elements replaced, up to an unmatched ``closer`` or the end; and where that is."""
        out, last, depth = [], "", 0
        while p < len(text):
            m = self.token.match(text, p)
            if not m:
                break
            tok, at = m.group(1), m.start(1)
            if tok.startswith("<") and not tok.startswith("<<=") and self.OPENS.search(last) and not (self.name == "typescript" and self.GENERIC.match(text, at)):
                end = self.element(text, at)
                if end > 0:
                    out.append(text[p:at] + ELEMENT + " " * (end - at - 1))
                    last, p = ELEMENT, end
                    continue
            if tok in ("{", "(", "["):
                depth += 1
            elif tok in ("}", ")", "]"):
                if not depth and tok == closer:
                    return "".join(out), at
                depth -= 1
            out.append(text[p : m.end()])
            if tok.strip() and not tok.startswith(("//", "/*")):
                last = tok if not tok[:1].isspace() else last
            if m.end() == p:
                break
            p = m.end()
        return "".join(out), -1 if closer else len(text)

    def held(self, text: str, p: int) -> int:
        """Behind the ``}`` of an expression that stands in an element at ``p``, or -1."""
        body, end = self.spliced(text, p + 1, "}")
        body = self.BLANK.sub("", body) and body
        if end < 0 or body and not self.expression(body.lstrip().removeprefix("...")):
            return -1
        return end + 1

    def element(self, text: str, p: int) -> int:
        """Behind an element that begins at ``p``, or -1 if it is not well formed."""
        names: list[str | None] = []
        while True:
            if text.startswith("</", p):
                m = self.TAG.match(text, p + 2)
                q = m.end()
                while text[q : q + 1].isspace():
                    q += 1
                if text[q : q + 1] != ">" or not names or names.pop() != m.group(1):
                    return -1
                p = q + 1
            else:
                m = self.TAG.match(text, p + 1)
                q = m.end()
                if not m.group(1) and text[q : q + 1] != ">":
                    return -1
                while True:
                    while text[q : q + 1].isspace():
                        q += 1
                    a = self.ATTRIBUTE.match(text, q)
                    if a and a.end() > q:
                        q = a.end()
                        if text[q - 1 : q] not in "\"'" and re.search(r"=\s*\Z", text[a.start() : q]):
                            q = self.held(text, q) if text[q] == "{" else self.element(text, q)
                    elif text[q : q + 1] == "{" and re.match(r"\{\s*\.\.\.", text[q : q + 80]):
                        q = self.held(text, q)
                    else:
                        break
                    if q < 0:
                        return -1
                if text.startswith("/>", q):
                    p = q + 2
                elif text[q : q + 1] == ">":
                    names.append(m.group(1))
                    p = q + 1
                else:
                    return -1
            if not names:
                return p
            while text[p : p + 1] != "<":  # children
                if p >= len(text) or text[p] in ">}":
                    return -1
                p = self.held(text, p) if text[p] == "{" else p + 1
                if p < 0:
                    return -1

    def expression(self, text: str) -> bool:
        kinds = "".join([self.classify[t] for t in self.token.findall(text)]).replace(NL, "")
        flat = self.grammar.flatten(kinds)
        return ERR not in flat and self.grammar.match("Seq", flat)


class Go(Brace):
    def __init__(self):
        ops = "; , . : = := <- ... + - * / % & | ^ << >> &^ < > <= >= == != && || ! ~ ++ -- += -= *= /= %= &= |= ^= <<= >>= &^="
        super().__init__(
            "go", GO_WORDS, "", ops, GO,
            {"(": ["Params", "Args", "Paren", "Imports", "VarList", "TypeList", "Assert"], "[": ["Empty", "TypeIn", "Length", "Index", "TypeArgs", "TypeParams"], "{": ["Block", "Lit", "Struct", "Iface", "Cases"]},
            listed={"Block": "Stmts"}, strings=rf"{DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{{1,9}}?)'", opexp=r"&\^=|<<=|>>=|\.\.\.|:=|<-|&\^|&&|\|\||\+\+|--|<<|>>|[-+*/%&|^=!<>]=",
            ASSIGN="+= -= *= /= %= &= |= ^= <<= >>= &^=", BINOP="+ - * / % & | ^ << >> &^ < > <= >= == != && ||", UNOP="+ - ! ^ * & <- ~",
        )
        k = self.kinds
        ender = "".join(k[x] for x in "IDENT NUM STR break continue fallthrough return ++ --".split()) + ")]}"
        self.breaks = re.compile(f"(?<=[{re.escape(ender)}])(N)|N")

    def lay_out(self, kinds: str) -> str:
        semi = self.kinds[";"]
        return self.breaks.sub(lambda m: semi if m.group(1) else "", kinds + NL)


class Rust(Brace):
    def __init__(self):
        ops = "; , . : = :: -> => .. ..= ... + - * / % & | ^ << < > <= == != && || ! ++ += -= *= /= %= &= |= ^= <<= @ ? # $ ~ yield _"
        ops = ops.replace(" ++", "")
        super().__init__(
            "rust", RUST_WORDS, RUST_SOFT, ops, RUST,
            {"(": ["Params", "Args", "Paren", "TupleType", "FnTypes", "TupleFields", "TuplePat", "Path1", "BoundParen", "Tree"], "[": ["Array", "Index", "ArrayType", "SlicePat", "Tokens"],
             "{": ["Block", "StructLit", "StructPat", "Fields", "Variants", "Impl", "Arms", "File", "UseList", "Any"]},
            listed={"Block": "Stmts"}, strings=rf"""b?r(\#*)".*?"\2|[bc]?"[^"\\]*(?:\\.[^"\\]*)*"|b?'(?:[^'\\\n]|\\(?:u\{{[^}}]*\}}|x[0-9a-fA-F]{{2}}|.))'|'[^\W\d]\w*""", word=r"r\#[^\W\d]\w*|[^\W\d]\w*",
            opexp=r"<<=|\.\.=|\.\.\.|::|->|=>|\.\.|<<|&&|\|\||[-+*/%&|^=!<]=", extra=["LIFE"],
            ASSIGN="+= -= *= /= %= &= |= ^= <<=", BINOP="+ - * / % & | ^ << < <= == != && ||", HOP="+ - * / % & | ^ << < <= == !=",
        )

    def tokens_of(self, text: str) -> list[str]:
        return [m[0] if isinstance(m, tuple) else m for m in self.token.findall(text)]

    def valid(self, text: str, jsx: bool = False) -> bool:
        classify = self.classify
        kinds = "".join([classify[t[0]] for t in self.token.findall(self.clean(text))])
        if ERR in kinds:
            return False
        flat = self.grammar.flatten(kinds.replace(NL, ""))
        return ERR not in flat and self.grammar.accepts("File", flat)

    def other(self, tok: str, c: str) -> str:
        if c == "'":
            return self.kinds["STR"] if tok[-1] == "'" and len(tok) > 2 else self.kinds["LIFE"] if len(tok) > 1 else ERR
        if tok[-1] in "\"#'" and len(tok) > 2 and c in "brc\"":
            return self.kinds["STR"]
        if len(tok) > 1 and tok[0] == '"' and tok[-1] == '"':
            return self.kinds["STR"]
        if tok.startswith("r#"):
            return self.kinds["IDENT"]
        if c == '"':
            return ERR
        return super().other(tok, c)


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    """The judge of a language, one for each Python worker."""
    js_roles = {"(": ["Args", "Params", "Paren", "Seq", "ForHead", "CatchParam"], "[": ["Array", "Seq1", "Computed"], "{": ["Block", "Object", "ClassBody", "Cases", "Names"]}
    if name == "python":
        return Python()
    if name == "javascript":
        return Script(name, JS + JS_ONLY, JS_SOFT, js_roles)
    if name == "typescript":
        roles = {"(": [*js_roles["("], "TypeParen"], "[": [*js_roles["["], "EmptyIdx", "TypeIdx", "Tuple", "IndexSig"], "{": [*js_roles["{"], "TypeBody", "EnumBody"]}
        return Script(name, JS + TS_ONLY, f"{JS_SOFT} {TS_SOFT} out global", roles)
    if name == "java":
        ops = "; , . : = :: -> ... ? + - * / % & | ^ << < > <= == != && || ! ~ ++ -- += -= *= /= %= &= |= ^= <<= @"
        return Brace(
            name, JAVA_WORDS, JAVA_SOFT, ops, JAVA,
            {"(": ["Args", "Params", "Paren", "AnnotArgs", "Cond", "ForHead", "Resources", "CatchParam", "LambdaParams", "CastType", "PrimCast", "Patterns"], "[": ["Empty", "Index"],
             "{": ["Block", "ClassBody", "EnumBody", "ArrayInit", "AnnotList", "Cases"]},
            listed={"Block": "Block"}, strings=rf'"""(?:[^"\\]|\\.|"(?!""))*"""|{DQ}|\'(?:[^\'\\\n]|\\(?:u+[0-9a-fA-F]{{4}}|[0-7]{{1,3}}|[^\n]))\'', word=r"[^\W\d][\w$]*|\$[\w$]*", opexp=r"<<=|\.\.\.|::|->|&&|\|\||\+\+|--|<<|[-+*/%&|^=!<]=", glue="else while",
            ASSIGN="= += -= *= /= %= &= |= ^= <<=", BINOP="+ - * / % & | ^ << < <= == != && ||",
        )
    if name == "go":
        return Go()
    if name == "rust":
        return Rust()
    raise KeyError(name)
