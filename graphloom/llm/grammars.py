"""Grammars of the supported languages, for recognition: operator precedence is left out where it decides no validity."""

RUST = r"""
@id: IDENT 'union' 'auto' 'default' 'macro_rules' 'raw' 'safe';
@pathid: @id 'self' 'Self' 'super' 'crate';
@lit: LIT 'true' 'false';
@lt: '<' 'J<';
@gt: '>' 'J>';
File: InnerAttr* Item* ;
InnerAttr: '#' '!' '[' AttrBody ']' ;
Attr: '#' '[' AttrBody ']' ;
AttrBody: 'unsafe' '(' AttrIn ')' | AttrIn ;
AttrIn: SimplePath ( Tree | '=' Expr )? ;
SimplePath: '::'? @pathid ( '::' @pathid )* ;
Tree: '(' Tok* ')' | '[' Tok* ']' | '{' Tok* '}' ;
Tok: %any | Tree ;
Item: Attr* ( Vis? Kind | MacroItem ) ;
MacroItem: 'macro_rules' '!' @id ( '{' Tok* '}' | '(' Tok* ')' ';' | '[' Tok* ']' ';' )
  | SimplePath '!' ( '{' Tok* '}' | '(' Tok* ')' ';' | '[' Tok* ']' ';' ) ;
Vis: 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' SimplePath ) ')' )? ;
Kind: 'use' UseTree ';'
  | 'unsafe'? 'mod' @id ( ';' | '{' InnerAttr* Item* '}' )
  | 'extern' 'crate' ( @id | 'self' ) ( 'as' ( @id | '_' ) )? ';'
  | Quals 'fn' Fn
  | 'struct' @id Generics? ( Where? '{' Fields? '}' | '(' Tuple? ')' Where? ';' | Where? ';' )
  | 'union' @id Generics? Where? '{' Fields? '}'
  | 'enum' @id Generics? Where? '{' ( Variant ( ',' Variant )* ','? )? '}'
  | 'const' ( @id | '_' ) ( ':' Type )? ( '=' Expr )? ';'
  | ( 'unsafe' | 'safe' )? 'static' 'mut'? @id ':' Type ( '=' Expr )? ';'
  | 'type' @id Generics? ( ':' Bounds? )? Where? ( '=' Type )? Where? ';'
  | 'unsafe'? 'auto'? 'trait' @id Generics? ( ':' Bounds? )? Where? '{' InnerAttr* TraitMember* '}'
  | 'trait' @id Generics? '=' Bounds? Where? ';'
  | 'default'? 'unsafe'? 'impl' ( Generics )? 'const'? '!'? Type ( 'for' Type )? Where? '{' InnerAttr* Member* '}'
  | 'unsafe'? 'extern' LIT? '{' InnerAttr* Member* '}' ;
Quals: 'default'? ( 'const' | 'async' | 'unsafe' | 'safe' | 'extern' LIT? )* ;
Member: Attr* ( Vis? MemberKind | MacroItem ) ;
MemberKind: Quals 'fn' Fn | Assoc ;
TraitMember: Attr* ( Vis? ( Quals 'fn' TraitFn | Assoc ) | MacroItem ) ;
Assoc: 'default'? 'const' ( @id | '_' ) ':' Type ( '=' Expr )? ';'
  | ( 'unsafe' | 'safe' )? 'static' 'mut'? @id ':' Type ( '=' Expr )? ';'
  | 'default'? 'type' @id Generics? ( ':' Bounds? )? Where? ( '=' Type )? Where? ';' ;
UseTree: SimplePath ( '::' UseTail | 'as' ( @id | '_' ) )? | '::'? UseTail ;
UseTail: '*' | '{' ( UseTree ( ',' UseTree )* ','? )? '}' ;
Fn: @id Generics? '(' Params? ')' ( '->' Type )? Where? ( Block | ';' ) ;
TraitFn: @id Generics? '(' TraitParams? ')' ( '->' Type )? Where? ( Block | ';' ) ;
Params: ( SelfParam | Param ) ( ',' Param )* ','? ;
Param: Attr* ( Pat ':' Type | '...' ) ;
TraitParams: ( SelfParam | TraitParam ) ( ',' TraitParam )* ','? ;
TraitParam: Attr* ( Pat ':' Type | '...' | Type ) ;
SelfParam: Attr* ( '&' Life? )? 'mut'? 'self' ( ':' Type )? ;
Life: LIFETIME ;
Fields: Field ( ',' Field )* ','? ;
Field: Attr* Vis? @id ':' Type ( '=' Expr )? ;
Tuple: TupleField ( ',' TupleField )* ','? ;
TupleField: Attr* Vis? Type ;
Variant: Attr* Vis? @id ( '{' Fields? '}' | '(' Tuple? ')' )? ( '=' Expr )? ;
Generics: @lt ( GParam ( ',' GParam )* ','? )? @gt ;
GParam: Attr* ( LIFETIME ( ':' ( LIFETIME ( '+' LIFETIME )* '+'? )? )? | @id ( ':' Bounds? )? ( '=' Type )? | 'const' @id ':' Type ( '=' ConstArg )? ) ;
ConstArg: Block | '-'? @lit | @pathid ;
Where: 'where' ( WPred ( ',' WPred )* ','? )? ;
WPred: LIFETIME ':' ( LIFETIME ( '+' LIFETIME )* )? | ForLts? Type ':' Bounds? ;
ForLts: 'for' Generics ;
Bounds: Bound ( '+' Bound )* '+'? ;
Bound: LIFETIME | ( '?' | 'const' | '~' 'const' | 'async' )? ForLts? TypePath | '(' '?'? ForLts? TypePath ')' | 'use' @lt ( UseArg ( ',' UseArg )* ','? )? @gt ;
UseArg: LIFETIME | @id | 'Self' ;
Type: TypeNB ( '+' Bound )* ;
TypeNB: '(' ( Type ( ',' Type )* ','? )? ')' | '!' | ( '&' | '&&' ) LIFETIME? 'mut'? TypeNB | '*' ( 'const' | 'mut' ) TypeNB
  | '[' Type ( ';' Expr )? ']' | '_' | ForLts? BareFn | ForLts TypePath | 'impl' Bounds | 'dyn' Bounds | TypePath ( '!' Tree )? ;
BareFn: ( 'const' | 'unsafe' | 'async' | 'extern' LIT? )* 'fn' '(' ( BareParam ( ',' BareParam )* ','? )? ')' ( '->' TypeNB )? ;
BareParam: Attr* ( ( @id | '_' ) ':' )? Type | '...' ;
TypePath: '::'? TypeSeg ( '::' TypeSeg )* | QSelf ( '::' TypeSeg )+ ;
QSelf: @lt Type ( 'as' TypePath )? @gt ;
TypeSeg: @pathid ( '::'? GArgs | '::'? '(' ( Type ( ',' Type )* ','? )? ')' ( '->' TypeNB )? )? ;
GArgs: @lt ( GArg ( ',' GArg )* ','? )? @gt ;
GArg: LIFETIME | Type | @id GArgs? '=' ( Type | ConstArg ) | @id GArgs? ':' Bounds | Block | '-'? LIT | 'true' | 'false' ;
Block: '{' InnerAttr* Stmts '}' ;
Stmts: Stmt* Attr* Expr? ;
Stmt: ';' | Attr* 'let' Pat ( ':' Type )? ( '=' Expr ( 'else' Block )? )? ';' | Item | Attr* Blocky ';'? | Attr* Expr ';' ;
Blocky: ( LIFETIME ':' )? ( Block | 'loop' Block | 'while' Expr! Block | 'for' Pat 'in' Expr! Block )
  | 'unsafe' Block | 'async' 'move'? Block | 'const' Block | If | 'match' Expr! '{' InnerAttr* Arms '}' ;
If: 'if' Expr! Block ( 'else' ( If | Block ) )? ;
Arms: Arm* LastArm? ;
Arm: ArmHead ( Blocky ','? | Expr ',' ) ;
LastArm: ArmHead Expr ;
ArmHead: Attr* Pat ( 'if' Expr )? '=>' ;
Pat: '|'? PatOne ( '|' PatOne )* ;
PatOne: '_' | '..' | 'ref'? 'mut'? @id ( '@' PatOne )? | PatLit RangeEnd? | ( '..=' | '..' ) ( PatLit | PatPath )
  | PatPath ( '{' PatFields? '}' | '(' PatList? ')' | '!' Tree | RangeEnd )? | ( '&' | '&&' ) 'mut'? PatOne
  | '(' PatList? ')' | '[' PatList? ']' | 'const' Block | 'box' PatOne ;
PatLit: '-'? LIT | 'true' | 'false' ;
RangeEnd: ( '..=' | '...' ) ( PatLit | PatPath ) | '..' ( PatLit | PatPath )? ;
PatPath: '::'? PatSeg ( '::' ( PatSeg | GArgs ) )* | QSelf ( '::' ( PatSeg | GArgs ) )+ ;
PatSeg: @pathid ;
PatList: Pat ( ',' Pat )* ','? ;
PatFields: PatField ( ',' PatField )* ','? ;
PatField: Attr* ( '..' | 'box'? 'ref'? 'mut'? @id | ( @id | LIT ) ':' Pat ) ;
Closure: ( 'static' | 'move' | 'async' | 'const' | ForLts )* ( '||' | '|' ( CParam ( ',' CParam )* ','? )? '|' ) ;
CParam: Attr* PatOne ( ':' Type )? ;
%mode
Expr: Un^ ( @bin Un^ | Shift Un^ | 'as' TypeNB | Range Un^ )* Range? | Range ( Un^ ( @bin Un^ | Shift Un^ | 'as' TypeNB )* )? ;
Range: '..' | '..=' ;
Un: ( @un | Borrow )* Post^ | 'let' Pat '=' Un^ ;
Post: Prim^ ( '?' | '.' ( @pathid ( '::' GArgs )? | LIT | 'await' ) | '(' Args? ')' | '[' Expr ']' )* ;
Prim: @lit | PathExpr ( '!' Tree | %{ '{' StructBody? '}' %} )?
  | '(' ( Attr* Expr ( ',' Expr )* ','? )? ')' | '[' ( Attr* Expr ( ';' Expr | ( ',' Expr )* ','? ) )? ']'
  | Blocky | Closure ( '->' TypeNB Block | Expr^ ) | 'return' Expr^? | 'break' LIFETIME? Expr^? | 'continue' LIFETIME? | 'yield' Expr^? | '_' ;
%end
@bin: '+' '-' '*' '/' '%' '^' '&' '|' '&&' '||' '=' '+=' '-=' '*=' '/=' '%=' '^=' '&=' '|=' '==' '!=' '<' '>';
@un: '-' '!' '*';
Borrow: ( '&' | '&&' ) ( 'mut' | 'raw' ( 'const' | 'mut' ) )? ;
Shift: 'J<' ( '<' | '=' | 'J<' '=' ) | 'J>' ( '>' | '=' | 'J>' '=' ) ;
PathExpr: '::'? @pathid ( '::' ( @pathid | GArgs ) )* | QSelf ( '::' ( @pathid | GArgs ) )+ ;
Args: Attr* Expr ( ',' Attr* Expr )* ','? ;
StructBody: StructField ( ',' StructField )* ','? | '..' Expr? | StructField ( ',' StructField )* ',' '..' Expr? ;
StructField: Attr* ( @id | ( @id | LIT ) ':' Expr ) ;
"""

GO = r"""
File: ( 'package' IDENT ';' ( 'import' ( Spec | '(' ( Spec ( ';' Spec )* ';'? )? ')' ) ';' )* ( Top ( ';' Top )* )? ';'? )? ;
Spec: ( IDENT | '.' )? STRING ;
Top: Decl | 'func' Receiver? IDENT TParams? Signature Block? ;
Receiver: '(' IDENT? '...'? Type ','? ')' ;
Decl: 'const' ( ConstSpec | '(' ( ConstSpec ( ';' ConstSpec )* ';'? )? ')' )
  | 'var' ( VarSpec | '(' ( VarSpec ( ';' VarSpec )* ';'? )? ')' )
  | 'type' ( TypeSpec | '(' ( TypeSpec ( ';' TypeSpec )* ';'? )? ')' ) ;
ConstSpec: IDENT ( ',' IDENT )* ( Type? '=' Exprs )? ;
VarSpec: IDENT ( ',' IDENT )* ( Type ( '=' Exprs )? | '=' Exprs ) ;
TypeSpec: IDENT TParams? '='? Type ;
TParams: '[' TParam ( ',' TParam )* ','? ']' ;
TParam: IDENT ( ',' IDENT )* Union ;
Union: '~'? Type ( '|' '~'? Type )* ;
Signature: Params Result? ;
Result: Params | Type ;
Params: '(' ( ( Unnamed ( ',' Unnamed )* | Named ( ',' Named )* ) ','? )? ')' ;
Unnamed: '...'? Type ;
Named: IDENT ( ',' IDENT )* '...'? Type ;
Type: TypeName ( '[' Type ( ',' Type )* ','? ']' )? | '*' Type | '(' Type ')' | '[' ( Expr | '...' )? ']' Type | 'map' '[' Type ']' Type
  | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | StructType | 'interface' '{' ( Elem ( ';' Elem )* ';'? )? '}' ;
StructType: 'struct' '{' ( Field ( ';' Field )* ';'? )? '}' ;
TypeName: IDENT ( '.' IDENT )? ;
Field: ( IDENT ( ',' IDENT )* Type | '*'? TypeName ( '[' Type ( ',' Type )* ','? ']' )? ) STRING? ;
Elem: IDENT Signature | Union ;
Block: '{' Stmts '}' ;
Stmts: Stmt? ( ';' Stmt? )* ;
Stmt: Decl | Simple | ( 'go' | 'defer' ) Call | 'return' Exprs? | 'break' IDENT? | 'continue' IDENT? | 'goto' IDENT | 'fallthrough'
  | Block | If | Switch | 'select' '{' ( CommClause )* '}' | For | IDENT ':' Stmt? ;
Simple: Exprs ( @assign Exprs | '++' | '--' | '<-' Expr )? ;
Header: Exprs! ( @assign Exprs! | '++' | '--' | '<-' Expr! )? ;
If: 'if' ( Header? ';' )? Expr! Block ( 'else' ( If | Block ) )? ;
Switch: 'switch' ( Header? ';' )? Header? '{' Clause* '}' ;
Clause: ( 'case' ExprOrType ( ',' ExprOrType )* | 'default' ) ':' Stmts ;
CommClause: ( 'case' Simple | 'default' ) ':' Stmts ;
For: 'for' ( Header? ';' Header? ';' Header? | ( Exprs! ( ':=' | '=' ) )? 'range' Expr! | Expr! )? Block ;
ExprOrType: Expr | Type ;
%mode
Exprs: Expr^ ( ',' Expr^ )* ;
Expr: Un^ ( @bin Un^ )* ;
Un: @un* Post^ ;
Post: Prim^ ( '.' ( IDENT | '(' ( Type | 'type' ) ')' ) | '[' Index ']' | CallArgs | %{ Lit %} )* ;
Prim: NUMBER | STRING | CHAR | IDENT | '(' ( Expr | Type ) ')' | 'func' Signature Block | LitType %{ Lit %} | LitType Lit | ConvType ;
%end
Call: Prim ( '.' ( IDENT | '(' ( Type | 'type' ) ')' ) | '[' Index ']' | CallArgs | Lit )* CallArgs ;
CallArgs: '(' ( ExprOrType ( ',' ExprOrType )* '...'? ','? )? ')' ;
LitType: '[' ( Expr | '...' )? ']' Type | 'map' '[' Type ']' Type | StructType ;
ConvType: 'chan' Type | 'interface' '{' ( Elem ( ';' Elem )* ';'? )? '}' | 'map' '[' Type ']' Type | '[' ']' Type ;
Index: ExprOrType ( ',' ExprOrType )* ','? | Expr? ':' Expr? ( ':' Expr )? ;
Lit: '{' ( Element ( ',' Element )* ','? )? '}' ;
Element: ( Value ':' )? Value ;
Value: Expr | Lit ;
@bin: '+' '-' '*' '/' '%' '&' '|' '^' '<<' '>>' '&^' '&&' '||' '==' '!=' '<' '<=' '>' '>=';
@un: '+' '-' '!' '^' '*' '&' '<-' '~';
@assign: '=' ':=' '+=' '-=' '*=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '&^=';
"""

TS = r"""
@soft: 'abstract' 'accessor' 'any' 'as' 'asserts' 'assert' 'bigint' 'boolean' 'constructor' 'declare' 'from' 'get' 'global' 'infer' 'intrinsic' 'is' 'keyof' 'module' 'namespace' 'never' 'number' 'object' 'of' 'out' 'override' 'readonly' 'require' 'satisfies' 'set' 'string' 'symbol' 'type' 'undefined' 'unique' 'unknown' 'using' 'async' 'let' 'static' 'private' 'protected' 'public' 'package' 'implements' 'interface';
@id: IDENT @soft;
@name: @id 'break' 'case' 'catch' 'class' 'const' 'continue' 'debugger' 'default' 'delete' 'do' 'else' 'enum' 'export' 'extends' 'false' 'finally' 'for' 'function' 'if' 'import' 'in' 'instanceof' 'new' 'null' 'return' 'super' 'switch' 'this' 'throw' 'true' 'try' 'typeof' 'var' 'void' 'while' 'with' 'await' 'yield';
@gt: '>' 'J>';
@lt: '<' 'J<';
@async: 'async' 'Jasync';
@let: 'let' 'Jlet';
@semi: ';' %asi;
File: ModuleItem* ;
ModuleItem: Stmt | Import | Export ;
Import: 'import' STRING With? @semi | 'import' 'type'? ( @id ( ',' ( NameSpace | Named ) )? | NameSpace | Named ) 'from' STRING With? @semi
  | 'import' 'type'? @id '=' ( 'require' '(' STRING ')' | EntityName ) @semi ;
With: ( 'with' | 'assert' ) '{' ( ( @name | STRING ) ':' STRING ( ',' ( @name | STRING ) ':' STRING )* ','? )? '}' ;
NameSpace: '*' 'as' @id ;
Named: '{' ( Specifier ( ',' Specifier )* ','? )? '}' ;
Specifier: 'type'? ( @name | STRING ) ( 'as' ( @name | STRING ) )? ;
Export: 'export' ( '*' ( 'as' ( @name | STRING ) )? 'from' STRING With? @semi | 'type'? Named ( 'from' STRING With? )? @semi | 'type' '*' ( 'as' @name )? 'from' STRING @semi
  | 'default' ( DefaultFunc | Decorator* 'abstract'? ClassExpr | Interface | Expr @semi ) | Declaration | '=' Expr @semi | 'as' 'namespace' @id @semi | 'import' 'type'? @id '=' ( 'require' '(' STRING ')' | EntityName ) @semi ) ;
Declaration: Var @semi | FuncDecl | Decorator* 'abstract'? Class | Interface | 'type' @id TParams? '=' Type @semi | 'const'? 'enum' @id '{' ( EnumMember ( ',' EnumMember )* ','? )? '}'
  | ( 'namespace' | 'module' ) ( EntityName | STRING ) ( '{' ModuleItem* '}' | @semi ) | 'declare' ( Declaration | AmbientVar @semi | 'global' '{' ModuleItem* '}' ) ;
EnumMember: ( @name | STRING | '[' Expr ']' ) ( '=' Assign )? ;
EntityName: @name ( '.' @name )* ;
AmbientVar: ( 'var' | @let | 'const' ) AmbientOne ( ',' AmbientOne )* ;
AmbientOne: Target ( ':' Type )? ;
Target: @id | Pattern ;
Pattern: '{' ( BindProp ( ',' BindProp )* ','? )? '}' | '[' ( BindElem? ( ',' BindElem? )* ) ']' ;
BindProp: '...' @id | PropName ':' Target ( '=' Assign )? | @id ( '=' Assign )? ;
BindElem: '...'? Target ( '=' Assign )? ;
FuncDecl: 'Jasync'? 'function' '*'? @id Signature ( Block | @semi ) ;
DefaultFunc: 'Jasync'? 'function' '*'? @id? Signature ( Block | @semi ) ;
Signature: TParams? '(' Params? ')' ( ':' RetType )? ;
Params: Param ( ',' Param )* ','? ;
Param: Decorator* ( 'public' | 'private' | 'protected' | 'readonly' | 'override' )* '...'? ( Target | 'this' ) '?'? ( ':' Type )? ( '=' Assign )? ;
RetType: Type | 'asserts'? ( @id | 'this' ) 'is' Type | 'asserts' ( @id | 'this' ) ;
Decorator: '@' ( @name ( '.' @name | TArgs? '(' Args? ')' )* | '(' Expr ')' ) ;
Class: 'class' @id ClassRest ;
ClassExpr: 'class' @id? ClassRest ;
ClassRest: TParams? ( 'extends' Lhs TArgs? )? ( 'implements' TypeRef ( ',' TypeRef )* )? '{' ClassMember* '}' ;
ClassMember: ';' | 'static' Block | Decorator* Mod* ( ( 'get' | 'set' )? '*'? MemberName ( '?' | '!' )? ( Signature ( Block | @semi ) | ( ':' Type )? ( '=' Assign )? @semi ) | IndexSig @semi ) ;
Mod: 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'override' | @async | 'declare' | 'accessor' ;
MemberName: PropName | PRIVATE ;
PropName: @name | STRING | NUMBER | '[' Expr ']' ;
Interface: 'interface' @id TParams? ( 'extends' TypeRef ( ',' TypeRef )* )? ObjType ;
Block: '{' Stmt* '}' ;
Stmt: Block | ';' | Declaration | ExprStmt | 'if' '(' Expr ')' Stmt ( 'else' Stmt )? | 'do' Stmt 'while' '(' Expr ')' ';'? | 'while' '(' Expr ')' Stmt
  | 'for' '(' ForHead ')' Stmt | 'for' 'await' '(' ForHead ')' Stmt | 'continue' @id? @semi | 'break' @id? @semi | 'return' Expr? @semi | 'throw' Expr @semi | 'with' '(' Expr ')' Stmt
  | 'switch' '(' Expr ')' '{' Case* '}' | @id ':' Stmt | 'try' Block ( Catch ( 'finally' Block )? | 'finally' Block ) | 'debugger' @semi ;
ExprStmt: Expr @semi ;
Catch: 'catch' ( '(' Target ( ':' Type )? ')' )? Block ;
Case: ( 'case' Expr | 'default' ) ':' Stmt* ;
ForHead: ( Var! | Expr! )? ';' Expr? ';' Expr? | ( 'var' | @let | 'const' | 'using' ) Target ( ':' Type )? ( '=' Assign! )? ( 'of' Assign | 'in' Expr ) | Lhs ( 'of' Assign | 'in' Expr ) ;
Args: Arg ( ',' Arg )* ','? ;
Arg: '...'? Assign ;
%mode
Var: ( 'var' | @let | 'const' | 'using' | 'await' 'using' ) VarOne^ ( ',' VarOne^ )* ;
VarOne: @id ( '!'? ':' Type )? ( '=' Assign^ )? | Pattern ( ':' Type )? '=' Assign^ ;
Expr: Assign^ ( ',' Assign^ )* ;
Assign: Arrow ( Assign^ | Block ) | 'yield' ( '*'? Assign^ )? | Cond^ | Lhs AssignOp Assign^ ;
Cond: Un ( Bin^ Un | ( 'as' | 'satisfies' ) Type )* ( '?' Assign ':' Assign^ )? ;
Bin: @op | 'J<' ( '<' | '=' ) | 'J>' ( '>' | '=' | 'J>' '>' ) | '<' | '>' | %{ 'in' %} ;
%end
AssignOp: @assign | 'J<' 'J<' '=' | 'J>' 'J>' '=' | 'J>' 'J>' 'J>' '=' ;
@op: '+' '-' '*' '/' '%' '**' '&' '|' '^' '&&' '||' '??' '==' '!=' '===' '!==' 'instanceof';
@assign: '=' '+=' '-=' '*=' '/=' '%=' '**=' '&=' '|=' '^=' '&&=' '||=' '??=';
Arrow: 'async'? ( @id | Signature ) '=>' ;
Un: @un* Postfix | 'await' Un ;
@un: '+' '-' '!' '~' 'typeof' 'void' 'delete' '++' '--' 'await' '<cast>';
Postfix: Lhs ( '++' | '--' )? ;
Lhs: Prim ( '.' ( @name | PRIVATE ) | '?.' ( @name | PRIVATE | '[' Expr ']' | TArgs? '(' Args? ')' ) | '[' Expr ']' | '!' | TArgs? '(' Args? ')' | TArgs Template | TArgs | Template )* ;
Prim: @id | 'this' | 'super' | NUMBER | STRING | REGEX | 'true' | 'false' | 'null' | Template | PRIVATE 'in' Un
  | '(' Expr ')' | '[' ArrayElem? ( ',' ArrayElem? )* ']' | '{' ( Prop ( ',' Prop )* ','? )? '}'
  | 'Jasync'? 'function' '*'? @id? Signature Block | Decorator* ClassExpr | 'new' ( '.' @name | NewTarget TArgs? ( '(' Args? ')' )? ) | 'import' ( '(' Args ')' | '.' @name ) %casts ;
NewTarget: Prim ( '.' ( @name | PRIVATE ) | '[' Expr ']' | Template | '!' )* ;
ArrayElem: '...'? Assign ;
Prop: '...' Assign | ( PropName ':' Assign | @id ( '=' Assign )? | ( @async? '*'? | 'get' | 'set' ) PropName Signature Block ) ;
Template: TPL | TPL_HEAD Expr ( TPL_MID Expr )* TPL_TAIL ;
TParams: @lt TParam ( ',' TParam )* ','? @gt ;
TParam: ( 'const' | 'in' | 'out' )* @id ( 'extends' Type )? ( '=' Type )? ;
TArgs: @lt Type ( ',' Type )* @gt ;
Type: Union ( 'extends' Union '?' Type ':' Type )? | ( 'abstract'? 'new' )? TParams? '(' Params? ')' '=>' RetType ;
Union: ( '|' | '&' )? TypeOp ( ( '|' | '&' ) TypeOp )* ;
TypeOp: ( 'keyof' | 'unique' | 'readonly' )* TypePost | 'infer' @id ( 'extends' Union )? ;
TypePost: TypePrim ( '[' Type? ']' )* ;
TypePrim: TypeRef | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? NUMBER | STRING | ObjType | '[' ( TupleElem ( ',' TupleElem )* ','? )? ']' | '(' Type ')'
  | 'typeof' ( EntityName | 'import' '(' Type ')' ( '.' @name )* ) TArgs? | 'import' '(' Type ( ',' Expr )? ')' ( '.' @name )* TArgs? | TplType | 'asserts' @id ;
TplType: TPL | TPL_HEAD Type ( TPL_MID Type )* TPL_TAIL ;
TypeRef: @id ( '.' @name )* TArgs? ;
TupleElem: '...'? ( @name '?'? ':' '...'? )? Type '?'? ;
ObjType: '{' ( TypeMember ( ( ';' | ',' | %asi ) TypeMember )* ( ';' | ',' | %asi )? )? '}' | '{' ( '+' | '-' )? 'readonly'? '[' @id 'in' Type ( 'as' Type )? ']' ( ( '+' | '-' )? '?' )? ( ':' Type )? ( ';' | ',' | %asi )? '}' ;
TypeMember: ( 'new' )? Signature | ( 'readonly' )? IndexSig | ( 'readonly' | 'get' | 'set' )* PropName '?'? ( Signature | ( ':' Type )? ) ;
IndexSig: '[' @id ':' Type ']' ( ':' Type )? ;
"""

#: Casts by angle brackets exist where elements do not.
TS_CASTS = "| TArgs1 Un ;\nTArgs1: @lt Type @gt"
TSX_ELEMENTS = r"""| Element ;
Element: 'X<' ( XName TArgs? XAttr* ( 'X/>' | 'X>' Child* 'X</' XName 'X>' ) | 'X>' Child* 'X</' 'X>' ) ;
XName: XNAME ( ( '.' | ':' ) XNAME )* ;
XAttr: XNAME ( ':' XNAME )? ( '=' ( STRING | '{' '...'? Assign '}' | Element ) )? | '{' '...' Assign '}' ;
Child: XTEXT | '{' ( '...'? Expr )? '}' | Element"""

PYTHON = r"""
@id: NAME 'match' 'case' 'type' '_';
File: ( NEWLINE | Stmt )* ;
Stmt: Simples | Compound ;
Simples: Simple ( ';' Simple )* ';'? NEWLINE ;
Simple: Assign | Stars | 'return' Stars? | 'raise' ( Expr ( 'from' Expr )? )? | 'pass' | 'break' | 'continue' | 'global' @id ( ',' @id )* | 'nonlocal' @id ( ',' @id )* | 'del' DelTargets
  | 'assert' Expr ( ',' Expr )? | Import | 'type' @id TParams? '=' Expr | Yield ;
Assign: ( Targets '=' )+ ( Stars | Yield ) | SingleTarget ( @aug ( Stars | Yield ) | ':' Expr ( '=' ( Stars | Yield ) )? ) ;
@aug: '+=' '-=' '*=' '@=' '/=' '%=' '&=' '|=' '^=' '<<=' '>>=' '**=' '//=';
Targets: StarTarget ( ',' StarTarget )* ','? ;
StarTarget: '*'? Target ;
Target: @id | Post Trailer | '(' Targets? ')' | '[' Targets? ']' ;
SingleTarget: @id | Post Trailer | '(' SingleTarget ')' ;
DelTargets: DelTarget ( ',' DelTarget )* ','? ;
DelTarget: @id | Post Trailer | '(' DelTargets? ')' | '[' DelTargets? ']' ;
Trailer: '.' @id | '[' Slices ']' ;
Import: 'import' Dotted ( 'as' @id )? ( ',' Dotted ( 'as' @id )? )* | 'from' ( '.' | '...' )* Dotted 'import' Names | 'from' ( '.' | '...' )+ 'import' Names ;
Dotted: @id ( '.' @id )* ;
Names: '*' | As ( ',' As )* | '(' As ( ',' As )* ','? ')' ;
As: @id ( 'as' @id )? ;
Block: NEWLINE INDENT Stmt+ DEDENT | Simples ;
Compound: Decorator* ( 'class' @id TParams? ( '(' Args? ')' )? ':' Block | 'async'? 'def' @id TParams? '(' Params? ')' ( '->' Expr )? ':' Block )
  | 'if' Named ':' Block ( 'elif' Named ':' Block )* ( 'else' ':' Block )? | 'while' Named ':' Block ( 'else' ':' Block )?
  | 'async'? 'for' Targets 'in' Stars ':' Block ( 'else' ':' Block )? | 'async'? 'with' ( With ( ',' With )* | '(' With ( ',' With )* ','? ')' ) ':' Block
  | 'try' ':' Block ( Except+ ( 'else' ':' Block )? ( 'finally' ':' Block )? | 'finally' ':' Block )
  | 'match' Subject ':' NEWLINE INDENT ( 'case' Patterns ( 'if' Named )? ':' Block )+ DEDENT ;
Decorator: '@' Named NEWLINE ;
With: Expr ( 'as' StarTarget )? ;
Except: 'except' '*'? ( Expr ( 'as' @id )? )? ':' Block ;
Subject: StarNamed ( ',' StarNamed )* ','? ;
Patterns: PatStar ( ',' PatStar )* ','? ;
PatStar: '*' @id | PatAs ;
PatAs: PatOr ( 'as' @id )? ;
PatOr: Pat ( '|' Pat )* ;
Pat: '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | Strings | 'None' | 'True' | 'False' | Dotted ( '(' ( PatArg ( ',' PatArg )* ','? )? ')' )? | '(' Patterns? ')' | '[' Patterns? ']'
  | '{' ( PatItem ( ',' PatItem )* ','? )? '}' ;
PatArg: ( @id '=' )? PatAs ;
PatItem: ( '-'? NUMBER ( ( '+' | '-' ) NUMBER )? | Strings | 'None' | 'True' | 'False' | Dotted ) ':' PatAs | '**' @id ;
TParams: '[' TParam ( ',' TParam )* ','? ']' ;
TParam: @id ( ':' Expr )? ( '=' Expr )? | '*' @id ( '=' StarExpr )? | '**' @id ( '=' Expr )? ;
Params: Param ( ',' Param )* ( ',' '/' ( ',' Param )* )? ( ',' StarParams )? ','? | StarParams ','? ;
Param: @id ( ':' Expr )? ( '=' Expr )? ;
StarParams: '*' @id ( ':' StarExpr )? ( ',' Param )* ( ',' KwParam )? | '*' ( ',' Param )+ ( ',' KwParam )? | KwParam ;
KwParam: '**' @id ( ':' Expr )? ;
Stars: StarExpr ( ',' StarExpr )* ','? ;
StarExpr: '*' Or | Expr ;
StarNamed: '*' Or | Named ;
Named: @id ':=' Expr | Expr ;
Yield: 'yield' ( 'from' Expr | Stars? ) ;
Expr: Disj ( 'if' Disj 'else' Expr )? | 'lambda' LParams? ':' Expr ;
LParams: LParam ( ',' LParam )* ( ',' '/' ( ',' LParam )* )? ( ',' LStar )? ','? | LStar ','? ;
LParam: @id ( '=' Expr )? ;
LStar: '*' @id ( ',' LParam )* ( ',' '**' @id )? | '*' ( ',' LParam )+ ( ',' '**' @id )? | '**' @id ;
Disj: Inv ( ( 'and' | 'or' ) Inv )* ;
Inv: 'not'* Cmp ;
Cmp: Or ( ( @cmp | 'not' 'in' | 'is' 'not'? ) Or )* ;
@cmp: '<' '>' '==' '>=' '<=' '!=' 'in';
Or: Un ( @arith Un )* ;
@arith: '+' '-' '*' '/' '//' '%' '@' '**' '&' '|' '^' '<<' '>>';
Un: ( '-' | '+' | '~' )* 'await'? Post ;
Post: Atom ( '.' @id | '[' Slices ']' | '(' ( Args | GenArg )? ')' )* ;
Slices: Slice ( ',' Slice )* ','? ;
Slice: Expr? ':' Expr? ( ':' Expr? )? | Named | '*' Or ;
GenArg: Named CompFor ;
Args: Arg ( ',' Arg )* ','? ;
Arg: Named | '*' Expr | @id '=' Expr | '**' Expr | Named CompFor ;
CompFor: ( 'async'? 'for' Targets 'in' Disj ( 'if' Cond )* )+ ;
Cond: Disj | @id ':=' Expr | 'lambda' LParams? ':' Expr ;
Atom: @id | NUMBER | Strings | 'None' | 'True' | 'False' | '...' | '(' ( Yield | Named CompFor | StarNamed ( ',' StarNamed )* ','? )? ')' | '[' ( Named CompFor | StarNamed ( ',' StarNamed )* ','? )? ']'
  | '{' ( DictItem ( ',' DictItem )* ','? | Expr ':' Expr CompFor | StarNamed ( ',' StarNamed )* ','? | Named CompFor )? '}' ;
DictItem: Expr ':' Expr | '**' Or ;
Strings: ( STRING | FString )+ ;
FString: FSTART FPart* FEND ;
FPart: FMID | '{' ( Stars | Yield ) '='? ( '!' NAME )? ( ':' FPart* )? '}' ;
"""

#: With which an expression statement does not begin: those are a block and declarations.
TS_NOT_FIRST = {"ExprStmt": ["{", "function", "Jasync", "class", "@"]}
