"""Grammars and token readers of the languages of source files.

SQL has the rules of three dialects, PostgreSQL, Greenplum and T-SQL, which run together: any
statement of a script may be of any of them. A reader gives the kinds of the tokens, or None
where a text has none, as with a string that never ends."""

from __future__ import annotations

import io
import re
import tokenize
from functools import lru_cache

from metaquarry.llm.gll import Grammar

SQL = r"""
script: (ts_stmt | GO | ';' | pg_stmt (';' | GO))* pg_stmt? ;

# names and types, for all dialects
ident: IDENT | BRACKET | SOFT ;
name: ident ('.' ident?)* ;
names: '(' ident (',' ident)* ')' ;
type: type_word (type_args)? type_tail* ;
type_word: name | 'DOUBLE' 'PRECISION' | 'CHARACTER' 'VARYING'? | 'NATIONAL' ('CHARACTER' | 'CHAR') 'VARYING'? | 'BIT' 'VARYING' | 'INTERVAL' ;
type_args: '(' (NUMBER | 'MAX') (',' NUMBER)? ')' ;
type_tail: SUBSCRIPT | 'ARRAY' SUBSCRIPT? | ('WITH' | 'WITHOUT') 'TIME' 'ZONE' | type_args ;

# expressions
expr: 'NOT'* pred (('AND' | 'OR') 'NOT'* pred)* ;
pred: arith pred_tail* | 'EXISTS' '(' query ')' ;
pred_tail: compare (arith | ('ANY' | 'ALL' | 'SOME') '(' (query | expr) ')')
  | 'IS' 'NOT'? ('NULL' | 'TRUE' | 'FALSE' | 'UNKNOWN' | 'DISTINCT' 'FROM' arith)
  | 'ISNULL' | 'NOTNULL'
  | 'NOT'? 'IN' '(' (query | expr (',' expr)*) ')'
  | 'NOT'? 'BETWEEN' 'SYMMETRIC'? arith 'AND' arith
  | 'NOT'? ('LIKE' | 'ILIKE' | 'SIMILAR' 'TO') arith ('ESCAPE' STRING)? ;
compare: '=' | '<' | '>' | '<=' | '>=' | '<>' | '!=' | '~' | '~*' | '!~' | '!~*' | '@>' | '<@' | '&&' ;
arith: sign* prim (binary sign* prim)* ;
sign: '+' | '-' | '~' ;
binary: '+' | '-' | '*' | '/' | '%' | '^' | '||' | '|' | '&' | '#' | '->' | '->>' | '#>' | '#>>' | '<<' | '>>' ;
prim: atom prim_tail* ;
prim_tail: '::' type | SUBSCRIPT | BRACKET | 'COLLATE' name | 'AT' 'TIME' 'ZONE' atom ;
atom: NUMBER | STRING | DOLLAR | VARIABLE | PARAMETER | 'NULL' | 'TRUE' | 'FALSE' | 'DEFAULT' | 'CURRENT'
  | name (call over?)? | soft_call call over?
  | type_literal STRING | 'INTERVAL' STRING ident?
  | '(' (query | expr (',' expr)*) ')' ('.' ident)?
  | 'CASE' expr? ('WHEN' expr 'THEN' expr)+ ('ELSE' expr)? 'END'
  | ('CAST' | 'TRY_CAST') '(' expr 'AS' type ')'
  | 'CONVERT' '(' type ',' expr (',' expr)? ')'
  | 'EXTRACT' '(' (ident | STRING) 'FROM' expr ')'
  | 'SUBSTRING' '(' expr ('FROM' expr ('FOR' expr)? | (',' expr)*) ')'
  | 'POSITION' '(' arith 'IN' arith ')'
  | 'TRIM' '(' ('BOTH' | 'LEADING' | 'TRAILING')? expr? ('FROM' expr)? (',' expr)? ')'
  | 'ARRAY' ('[' (expr (',' expr)*)? ']' | SUBSCRIPT | BRACKET | '(' query ')')
  | 'ROW' '(' (expr (',' expr)*)? ')' ;
type_literal: IDENT | SOFT ;
soft_call: 'LEFT' | 'RIGHT' | 'REPLACE' | 'IF' | 'COALESCE' | 'UPDATE' | 'EXISTS' ;
call: '(' ( '*' | ('DISTINCT' | 'ALL')? arg (',' arg)* ('ORDER' 'BY' sorts)? )? ')' ('WITHIN' 'GROUP' '(' 'ORDER' 'BY' sorts ')')? ('FILTER' '(' 'WHERE' expr ')')? ;
arg: expr | ident (':=' | '=>') expr | query ;
over: 'OVER' (ident | '(' ident? ('PARTITION' 'BY' expr (',' expr)*)? ('ORDER' 'BY' sorts)? frame? ')') ;
frame: ('ROWS' | 'RANGE' | 'GROUPS') (bound | 'BETWEEN' bound 'AND' bound) ;
bound: 'UNBOUNDED' ('PRECEDING' | 'FOLLOWING') | 'CURRENT' 'ROW' | arith ('PRECEDING' | 'FOLLOWING') ;
sorts: sort (',' sort)* ;
sort: expr ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))? ;

# queries
query: with? query_body ;
with: 'WITH' 'RECURSIVE'? cte (',' cte)* ;
cte: ident names? 'AS' ('NOT'? 'MATERIALIZED')? '(' (query | insert | update | delete) ')' ;
query_body: query_term (('UNION' | 'EXCEPT' | 'INTERSECT') ('ALL' | 'DISTINCT')? query_term)* query_tail* ;
query_term: select | '(' query ')' | 'VALUES' row (',' row)* | 'TABLE' name ;
query_tail: 'ORDER' 'BY' sorts | 'LIMIT' (expr | 'ALL') | 'OFFSET' arith ('ROW' | 'ROWS')?
  | 'FETCH' ('FIRST' | 'NEXT') arith? ('ROW' | 'ROWS') 'ONLY' | 'FOR' ('UPDATE' | 'SHARE' | 'XML' ident? | 'BROWSE') ('OF' name)? ('NOWAIT')?
  | 'OPTION' '(' option_word+ ')' ;
option_word: ident | NUMBER | ',' | 'ORDER' | 'GROUP' | 'FOR' | 'WITH' ;
row: '(' expr (',' expr)* ')' ;
select: 'SELECT' ('ALL' | 'DISTINCT' ('ON' '(' expr (',' expr)* ')')?)? top? (item (',' item)*) ('INTO' into_words name)? ('FROM' sources)? ('WHERE' expr)? ('GROUP' 'BY' group (',' group)*)? ('HAVING' expr)? ('WINDOW' ident 'AS' '(' ('PARTITION' 'BY' expr (',' expr)*)? ('ORDER' 'BY' sorts)? frame? ')')? ;
into_words: ('TEMPORARY' | 'TEMP' | 'UNLOGGED')? 'TABLE'? ;
top: 'TOP' (NUMBER | '(' expr ')') 'PERCENT'? ('WITH' 'TIES')? ;
item: '*' | expr ('AS' alias | ident)? | VARIABLE '=' expr | ident '=' expr | name '.' '*' ;
alias: ident | STRING | word ;
word: 'VALUE' | 'LEFT' | 'RIGHT' | 'KEY' | 'DEFAULT' | 'CHECK' | 'COLUMN' ;
group: expr | ('ROLLUP' | 'CUBE') row | 'GROUPING' 'SETS' '(' group (',' group)* ')' | '(' ')' ;
sources: source (',' source)* ;
source: table (join)* ;
join: ('INNER' | ('LEFT' | 'RIGHT' | 'FULL') 'OUTER'?)? 'JOIN' table ('ON' expr | 'USING' names) | ('CROSS' | 'NATURAL' ('LEFT' | 'RIGHT' | 'INNER' | 'FULL')?) 'JOIN' table | ('CROSS' | 'OUTER') 'APPLY' table ;
table: ('ONLY'? name '*'? | name call ('WITH' 'ORDINALITY')? | 'LATERAL'? '(' (query | source) ')' | VARIABLE | 'LATERAL' name call) table_alias? hint? sample? ;
table_alias: 'AS'? ident (names | '(' ident type (',' ident type)* ')')? ;
hint: 'WITH' '(' ident (',' ident)* ')' | '(' 'NOLOCK' ')' ;
sample: 'TABLESAMPLE' ident '(' expr ')' ;

# changes of rows
insert: with? 'INSERT' 'INTO'? (name | VARIABLE) ('AS' ident)? (names)? ('OVERRIDING' ident 'VALUE')? output? (query | 'DEFAULT' 'VALUES' | '(' query ')' | ts_exec) conflict? returning? ;
conflict: 'ON' 'CONFLICT' (names ('WHERE' expr)? | 'ON' 'CONSTRAINT' ident)? 'DO' ('NOTHING' | 'UPDATE' 'SET' sets ('WHERE' expr)?) ;
returning: 'RETURNING' ('*' | item (',' item)*) ;
output: 'OUTPUT' item (',' item)* ('INTO' (name | VARIABLE) names?)? ;
update: with? 'UPDATE' top? 'ONLY'? (name | VARIABLE) ('AS'? ident)? hint? 'SET' sets output? ('FROM' sources)? ('WHERE' (expr | 'CURRENT' 'OF' ident))? returning? ;
sets: set (',' set)* ;
set: (name SUBSCRIPT? | VARIABLE) set_op expr | names '=' ('ROW'? row | '(' query ')') | VARIABLE '=' name '=' expr ;
set_op: '=' | '+=' | '-=' | '*=' ;
delete: with? 'DELETE' top? ('FROM' 'ONLY'? (name | VARIABLE) ('AS'? ident)? | name) hint? output? ('USING' sources | 'FROM' sources)? ('WHERE' (expr | 'CURRENT' 'OF' ident))? returning? ;
merge: with? 'MERGE' 'INTO'? name hint? ('AS'? ident)? 'USING' table 'ON' expr merge_when+ output? ;
merge_when: 'WHEN' 'NOT'? 'MATCHED' ('BY' ident)? ('AND' expr)? 'THEN' ('UPDATE' 'SET' sets | 'DELETE' | 'INSERT' names? ('VALUES' row | 'DEFAULT' 'VALUES') | 'DO' 'NOTHING') ;
truncate: 'TRUNCATE' 'TABLE'? 'ONLY'? name (',' name)* (('RESTART' | 'CONTINUE') 'IDENTITY')? ('CASCADE' | 'RESTRICT')? ;

# tables
columns: '(' (element (',' element)*)? ')' ;
element: ident type column_rule* | table_rule | 'LIKE' name (('INCLUDING' | 'EXCLUDING') ident)* | ident 'AS' expr 'PERSISTED'? ;
column_rule: ('CONSTRAINT' ident)? ('NOT'? 'NULL' | 'DEFAULT' default | 'PRIMARY' 'KEY' clustering? | 'UNIQUE' clustering? | 'CHECK' '(' expr ')' ('NO' 'INHERIT')? | references | 'GENERATED' ('ALWAYS' | 'BY' 'DEFAULT') 'AS' ('IDENTITY' ('(' sequence_option* ')')? | '(' expr ')' 'STORED') | 'IDENTITY' ('(' sign? NUMBER ',' sign? NUMBER ')')?)
  | 'COLLATE' name | 'ENCODING' options | 'SPARSE' | 'ROWGUIDCOL' | 'DEFERRABLE' | 'INITIALLY' ident ;
default: arith ;
clustering: 'CLUSTERED' | 'NONCLUSTERED' ;
references: 'REFERENCES' name names? ('MATCH' ident | 'ON' ('DELETE' | 'UPDATE') ('CASCADE' | 'RESTRICT' | 'NO' 'ACTION' | 'SET' ('NULL' | 'DEFAULT')))* ;
table_rule: ('CONSTRAINT' ident)? (('PRIMARY' 'KEY' | 'UNIQUE') clustering? key_columns with_options? on_group? | 'FOREIGN' 'KEY' names references | 'CHECK' '(' expr ')' | 'EXCLUDE' ('USING' ident)? '(' expr 'WITH' compare (',' expr 'WITH' compare)* ')') ('NOT'? 'DEFERRABLE' | 'INITIALLY' ident)* ;
key_columns: '(' ident ('ASC' | 'DESC')? (',' ident ('ASC' | 'DESC')?)* ')' ;
options: '(' option (',' option)* ')' ;
option: name ('=' option_value)? ;
option_value: sign? NUMBER | STRING | ident | 'TRUE' | 'FALSE' | 'ON' | 'COLUMN' | 'ROW' | 'NULL' ;
with_options: 'WITH' options ;
on_group: 'ON' (ident | 'PRIMARY') ;
sequence_option: 'AS' type | 'INCREMENT' 'BY'? sign? NUMBER | ('MINVALUE' | 'MAXVALUE') sign? NUMBER | 'NO' ('MINVALUE' | 'MAXVALUE' | 'CYCLE') | 'START' 'WITH'? sign? NUMBER | 'CACHE' NUMBER | 'CYCLE' | 'OWNED' 'BY' name ;
not_exists: 'IF' 'NOT' 'EXISTS' ;
if_exists: 'IF' 'EXISTS' ;

# PostgreSQL and Greenplum statements
pg_stmt: pg_prefix* (query | insert | update | delete | merge | truncate | pg_table | gp_table | pg_view | pg_matview | pg_function | pg_trigger | pg_index | pg_drop | pg_alter | pg_grant | pg_other) ;
pg_prefix: 'EXPLAIN' ident* | 'PREPARE' ident names? 'AS' ;
pg_table: 'CREATE' scope? 'TABLE' not_exists? name (columns pg_partition_by? | 'OF' name columns? | 'PARTITION' 'OF' name columns? ('FOR' 'VALUES' partition_bound | 'DEFAULT') pg_partition_by?) pg_table_tail* ;
scope: ('GLOBAL' | 'LOCAL')? ('TEMPORARY' | 'TEMP') | 'UNLOGGED' ;
pg_table_tail: 'INHERITS' '(' name (',' name)* ')' | with_options | 'WITHOUT' 'OIDS' | 'ON' 'COMMIT' ('DROP' | 'DELETE' 'ROWS' | 'PRESERVE' 'ROWS') | 'TABLESPACE' ident | 'AS' query ('WITH' 'NO'? 'DATA')? | 'USING' ident ;
pg_partition_by: 'PARTITION' 'BY' ('RANGE' | 'LIST' | 'HASH') '(' expr (',' expr)* ')' ;
partition_bound: 'FROM' row 'TO' row | 'IN' row | 'WITH' options ;
gp_table: 'CREATE' (scope | ('READABLE' | 'WRITABLE')? 'EXTERNAL' 'WEB'?)? 'TABLE' not_exists? name (columns | 'AS' '(' query ')' | 'AS' query)? gp_tail* ;
gp_tail: pg_table_tail | 'DISTRIBUTED' ('BY' '(' ident ident? (',' ident ident?)* ')' | 'RANDOMLY' | 'REPLICATED') | gp_partition | 'LOCATION' '(' STRING (',' STRING)* ')' | 'FORMAT' STRING options_list? | 'ENCODING' STRING | 'LOG' 'ERRORS' | 'SEGMENT' 'REJECT' 'LIMIT' NUMBER ('ROWS' | 'PERCENT')? | 'EXECUTE' STRING ('ON' ident+)? ;
options_list: '(' (ident | STRING | NUMBER | '=' | 'AS' | 'NULL' | ',' | 'ESCAPE' | 'QUOTE' | 'DELIMITER')+ ')' ;
gp_partition: 'PARTITION' 'BY' ('RANGE' | 'LIST' | 'HASH') '(' ident (',' ident)* ')' ('SUBPARTITION' 'BY' ('RANGE' | 'LIST' | 'HASH') '(' ident ')' ('SUBPARTITION' 'TEMPLATE' gp_parts)?)* gp_parts? ;
gp_parts: '(' gp_part (',' gp_part)* ')' ;
gp_part: ('DEFAULT' ('PARTITION' | 'SUBPARTITION') ident | (('PARTITION' | 'SUBPARTITION') ident?)? (gp_start gp_end? | gp_end | 'VALUES' row) gp_every?) with_options? gp_parts? | 'COLUMN' ident 'ENCODING' options ;
gp_start: 'START' '(' expr ')' ('INCLUSIVE' | 'EXCLUSIVE')? ;
gp_end: 'END' '(' expr ')' ('INCLUSIVE' | 'EXCLUSIVE')? ;
gp_every: 'EVERY' '(' expr ')' ;
pg_view: 'CREATE' ('OR' 'REPLACE')? (scope | 'RECURSIVE')? 'VIEW' name names? with_options? 'AS' query ('WITH' ('CASCADED' | 'LOCAL')? 'CHECK' 'OPTION')? ;
pg_matview: 'CREATE' 'MATERIALIZED' 'VIEW' not_exists? name names? ('USING' ident)? with_options? ('TABLESPACE' ident)? 'AS' query ('WITH' 'NO'? 'DATA')? ('DISTRIBUTED' ('BY' names | 'RANDOMLY' | 'REPLICATED'))? ;
pg_function: 'CREATE' ('OR' 'REPLACE')? ('FUNCTION' | 'PROCEDURE') name '(' (parameter (',' parameter)*)? ')' ('RETURNS' ('TABLE' '(' ident type (',' ident type)* ')' | 'SETOF'? type))? function_option+ ;
parameter: ('IN' | 'OUT' | 'INOUT' | 'VARIADIC')? ident? ('OUT' | 'IN')? type (('DEFAULT' | '=' | ':=') expr)? ;
function_option: 'LANGUAGE' (ident | STRING) | 'AS' (DOLLAR | STRING) (',' STRING)? | 'IMMUTABLE' | 'STABLE' | 'VOLATILE' | 'NOT'? 'LEAKPROOF' | 'STRICT' | ('CALLED' | 'RETURNS' 'NULL') 'ON' 'NULL' 'INPUT' | 'EXTERNAL'? 'SECURITY' ('DEFINER' | 'INVOKER') | 'COST' NUMBER | 'ROWS' NUMBER | 'WINDOW' | 'PARALLEL' ident | 'SET' ident ('=' | 'TO') (ident | STRING | NUMBER) (',' ident)* | 'NO' 'SQL' | 'CONTAINS' 'SQL' | 'READS' 'SQL' 'DATA' | 'MODIFIES' 'SQL' 'DATA' | 'EXECUTE' 'ON' ident+ | 'RETURN' expr | 'BEGIN' 'ATOMIC' ((query | insert | update | delete | merge) ';')* 'END' ;
pg_trigger: 'CREATE' ('OR' 'REPLACE')? 'CONSTRAINT'? 'TRIGGER' ident ('BEFORE' | 'AFTER' | 'INSTEAD' 'OF') event ('OR' event)* 'ON' name ('FROM' name)? ('NOT'? 'DEFERRABLE' | 'INITIALLY' ident)* ('REFERENCING' (('OLD' | 'NEW') 'TABLE' 'AS'? ident)+)? ('FOR' 'EACH'? ('ROW' | 'STATEMENT'))? ('WHEN' '(' expr ')')? 'EXECUTE' ('FUNCTION' | 'PROCEDURE') name '(' (expr (',' expr)*)? ')' ;
event: 'INSERT' | 'DELETE' | 'TRUNCATE' | 'UPDATE' ('OF' ident (',' ident)*)? ;
pg_index: 'CREATE' 'UNIQUE'? clustering? 'INDEX' 'CONCURRENTLY'? (not_exists? ident)? 'ON' 'ONLY'? name ('USING' ident)? '(' index_part (',' index_part)* ')' ('INCLUDE' names)? with_options? ('TABLESPACE' ident)? ('WHERE' expr)? ;
index_part: expr ('COLLATE' name)? ident? ('ASC' | 'DESC')? ('NULLS' ('FIRST' | 'LAST'))? ;
kind: 'TABLE' | 'VIEW' | 'MATERIALIZED' 'VIEW' | 'FUNCTION' | 'PROCEDURE' | 'INDEX' | 'SEQUENCE' | 'SCHEMA' | 'TYPE' | 'DATABASE' | 'EXTERNAL' 'TABLE' | 'ROLE' | 'USER' | 'DOMAIN' | 'EXTENSION' ;
pg_drop: 'DROP' (kind 'CONCURRENTLY'? if_exists? dropped (',' dropped)* | ('TRIGGER' | 'RULE') if_exists? ident 'ON' name) ('CASCADE' | 'RESTRICT')? ;
dropped: name ('(' (parameter (',' parameter)*)? ')')? ;
pg_alter: 'ALTER' kind if_exists? 'ONLY'? dropped alteration (',' alteration)* ;
alteration: 'ADD' (('COLUMN'? not_exists? ident type column_rule*) | table_rule) | 'DROP' ('COLUMN' | 'CONSTRAINT')? if_exists? ident ('CASCADE' | 'RESTRICT')? | 'ALTER' 'COLUMN'? ident (('SET' 'DATA')? 'TYPE' type ('USING' expr)? | 'SET' ('DEFAULT' expr | 'NOT' 'NULL') | 'DROP' ('DEFAULT' | 'NOT' 'NULL')) | 'RENAME' (('COLUMN' | 'CONSTRAINT')? ident)? 'TO' ident | 'OWNER' 'TO' ident | 'SET' ('SCHEMA' ident | 'TABLESPACE' ident | options | 'WITH'? options? 'DISTRIBUTED' ('BY' names | 'RANDOMLY' | 'REPLICATED')) | ('ENABLE' | 'DISABLE') 'TRIGGER' ident | 'CLUSTER' 'ON' ident | ('ATTACH' | 'DETACH') 'PARTITION' name ('FOR' 'VALUES' partition_bound)? ;
pg_grant: ('GRANT' | 'REVOKE') privileges 'ON' ('ALL'? kind_word)? dropped (',' dropped)* ('TO' | 'FROM') grantee (',' grantee)* ('WITH' 'GRANT' 'OPTION')? ('CASCADE')? | ('GRANT' | 'REVOKE') ident (',' ident)* ('TO' | 'FROM') ident (',' ident)* ;
kind_word: kind | 'OBJECT' '::' ;
privileges: 'ALL' ident? | privilege (',' privilege)* ;
privilege: ('SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' | 'TRUNCATE' | 'REFERENCES' | 'TRIGGER' | 'EXECUTE' | ident) names? ;
grantee: ident | 'GROUP' ident | 'PUBLIC' ;
pg_other: 'COMMENT' 'ON' ('COLUMN' | 'CONSTRAINT' ident 'ON' | 'TRIGGER' ident 'ON' | kind) dropped 'IS' (STRING | 'NULL')
  | 'CREATE' 'SCHEMA' not_exists? ident ('AUTHORIZATION' ident)? | 'CREATE' scope? 'SEQUENCE' not_exists? name sequence_option* | 'CREATE' 'EXTENSION' not_exists? ident | 'CREATE' 'TYPE' name 'AS' ('ENUM' '(' STRING (',' STRING)* ')' | '(' ident type (',' ident type)* ')')
  | ('ANALYZE' | 'VACUUM') ident* (name names?)? | 'REINDEX' ('TABLE' | 'INDEX') name | 'REFRESH' 'MATERIALIZED' 'VIEW' 'CONCURRENTLY'? name ('WITH' 'NO'? 'DATA')?
  | 'SET' ('SESSION' | 'LOCAL')? (name ('=' | 'TO') (set_value (',' set_value)*) | 'ROLE' ident | 'TIME' 'ZONE' set_value) | 'RESET' (name | 'ALL') | 'SHOW' (name | 'ALL')
  | ('BEGIN' | 'START' 'TRANSACTION' | 'COMMIT' | 'ROLLBACK' | 'END') ('WORK' | 'TRANSACTION')? | 'SAVEPOINT' ident | 'DO' ('LANGUAGE' ident)? DOLLAR ('LANGUAGE' ident)? | 'DO' STRING
  | 'CALL' name '(' (arg (',' arg)*)? ')' | 'LOCK' 'TABLE'? name ('IN' ident+ 'MODE')? | 'COPY' name names? ('FROM' | 'TO') (STRING | ident) ('WITH'? copy_option*) | 'NOTIFY' ident | 'EXECUTE' ident ('(' expr (',' expr)* ')')? | 'DISCARD' ('ALL' | ident) ;
set_value: ident | STRING | sign? NUMBER | 'TRUE' | 'FALSE' | 'ON' | 'DEFAULT' | 'LOCAL' ;
copy_option: options | ident | STRING | 'AS' | 'NULL' | 'DELIMITER' | 'QUOTE' | 'ESCAPE' ;

# T-SQL statements
ts_stmt: ts_simple ';'? | ts_module ;
ts_simple: query | insert | update | delete | merge | truncate | ts_declare | ts_set | ts_exec | ts_table | ts_index | ts_drop | ts_alter | ts_if | ts_while | ts_block | ts_try | pg_grant | ts_word ;
ts_declare: 'DECLARE' declared (',' declared)* ;
declared: VARIABLE 'AS'? (type ('=' expr)? | 'TABLE' columns | 'CURSOR') | ident 'CURSOR' ident* 'FOR' query ;
ts_set: 'SET' (VARIABLE set_op expr | set_switch ('ON' | 'OFF') | 'IDENTITY_INSERT' name ('ON' | 'OFF') | 'TRANSACTION' 'ISOLATION' 'LEVEL' ident+ | 'DATEFORMAT' ident | ident sign? NUMBER) ;
set_switch: ident (',' ident)* ;
ts_exec: ('EXEC' | 'EXECUTE') ((VARIABLE '=')? (name | VARIABLE) (ts_arg (',' ts_arg)*)? | '(' expr ')' ('AS' ident '=' STRING)? | 'AS' ident ('=' STRING)?) ('WITH' 'RECOMPILE')? ;
ts_arg: (VARIABLE '=')? (sign? NUMBER | STRING | VARIABLE | ident | 'NULL' | 'DEFAULT') ('OUTPUT' | 'OUT')? ;
ts_table: 'CREATE' 'TABLE' name columns (on_group | 'TEXTIMAGE_ON' ident | with_options)* ;
ts_index: 'CREATE' 'UNIQUE'? clustering? 'COLUMNSTORE'? 'INDEX' ident 'ON' name key_columns? ('INCLUDE' names)? ('WHERE' expr)? with_options? on_group? ;
ts_drop: 'DROP' (('TABLE' | 'VIEW' | 'PROCEDURE' | 'PROC' | 'FUNCTION' | 'TRIGGER' | 'SCHEMA' | 'SEQUENCE' | 'TYPE' | 'SYNONYM') if_exists? name (',' name)* | 'INDEX' if_exists? name ('ON' name)?) ;
ts_alter: 'ALTER' 'TABLE' name (('WITH' ('CHECK' | 'NOCHECK'))? 'ADD' (element (',' element)*) | 'ALTER' 'COLUMN' ident type ('NOT'? 'NULL')? | 'DROP' ('COLUMN' | 'CONSTRAINT')? if_exists? ident (',' ident)* | ('CHECK' | 'NOCHECK') 'CONSTRAINT' (ident | 'ALL')) ;
ts_if: 'IF' expr ts_one ('ELSE' ts_one)? ;
ts_while: 'WHILE' expr ts_one ;
ts_one: ts_simple ';'? ;
ts_block: 'BEGIN' (ts_one | ';')+ 'END' ;
ts_try: 'BEGIN' 'TRY' (ts_one | ';')+ 'END' 'TRY' ';'? 'BEGIN' 'CATCH' (ts_one | ';')* 'END' 'CATCH' ;
ts_word: 'PRINT' expr | 'RETURN' expr? | 'BREAK' | 'CONTINUE' | 'USE' ident | ('BEGIN' | 'COMMIT' | 'ROLLBACK' | 'SAVE') ('TRAN' | 'TRANSACTION') (ident | VARIABLE)? | ('COMMIT' | 'ROLLBACK') | 'RAISERROR' '(' expr (',' expr)* ')' ('WITH' ident)? | 'THROW' (expr ',' expr ',' expr)? | 'WAITFOR' 'DELAY' STRING | ('OPEN' | 'CLOSE' | 'DEALLOCATE') (ident | VARIABLE) | 'FETCH' 'NEXT' 'FROM' (ident | VARIABLE) 'INTO' VARIABLE (',' VARIABLE)* | 'GOTO' ident ;
ts_create: 'CREATE' ('OR' 'ALTER')? | 'ALTER' ;
ts_module: ts_create ('PROCEDURE' | 'PROC') name (ts_params | '(' ts_params ')')? ('WITH' ident (',' ident)*)? ('FOR' 'REPLICATION')? 'AS' ts_body
  | ts_create 'VIEW' name names? ('WITH' ident (',' ident)*)? 'AS' query ('WITH' 'CHECK' 'OPTION')? ';'?
  | ts_create 'FUNCTION' name '(' ts_params? ')' 'RETURNS' (type | 'TABLE' | VARIABLE 'TABLE' columns) ('WITH' ident (',' ident)*)? 'AS'? ('BEGIN' (ts_one | ';')+ 'END' | 'RETURN' '('? query ')'?) ';'?
  | ts_create 'TRIGGER' name 'ON' name ('WITH' ident)? ('FOR' | 'AFTER' | 'INSTEAD' 'OF') event (',' event)* 'AS' ts_body
  | 'CREATE' 'SCHEMA' ident ('AUTHORIZATION' ident)? ';'? ;
ts_params: ts_param (',' ts_param)* ;
ts_param: VARIABLE 'AS'? type ('NOT'? 'NULL')? ('=' (sign? NUMBER | STRING | 'NULL' | ident))? ('OUTPUT' | 'OUT' | 'READONLY')? ;
ts_body: (ts_one | ';')+ ;
"""

# Words that no dialect here takes as a plain name.
RESERVED = """
SELECT FROM WHERE AND OR NOT NULL IN AS ON CREATE TABLE UNION EXCEPT INTERSECT GROUP ORDER HAVING LIMIT OFFSET DISTINCT
CASE WHEN THEN ELSE END PRIMARY UNIQUE FOREIGN REFERENCES CHECK CONSTRAINT DEFAULT USING WITH JOIN LEFT RIGHT INNER OUTER
FULL CROSS NATURAL IS LIKE ILIKE BETWEEN EXISTS INTO INSERT UPDATE DELETE DROP ALTER MERGE TRUNCATE VALUES SET BEGIN
DECLARE EXEC EXECUTE IF WHILE RETURN PRINT GRANT REVOKE FOR TO BY ALL ANY SOME BOTH LEADING TRAILING CAST FETCH TRUE FALSE
COLLATE DESC ASC RETURNING LATERAL ONLY WINDOW CURRENT_ROW PROC USE GOTO BREAK CONTINUE COMMIT ROLLBACK TOP OVER
APPLY PIVOT UNPIVOT THROW RAISERROR WAITFOR OPEN CLOSE DEALLOCATE DISTRIBUTED
""".split()

PYTHON = r"""
file: (NEWLINE | stmt)* ;
stmt: simple_line | if | while | for | try | with | decorated | function | class | async | match ;
simple_line: simple (';' simple)* ';'? NEWLINE ;
simple: assignment | star_exprs | 'del' targets | 'pass' | 'break' | 'continue' | 'return' star_exprs? | raise | global | import | 'assert' expr (',' expr)? | type_alias ;
assignment: (targets '=')+ (yield | star_exprs) | target ':' expr ('=' (yield | star_exprs))? | target AUGMENT (yield | star_exprs) | yield ;
name: NAME | 'match' | 'case' | 'type' | '_' ;
targets: star_target (',' star_target)* ','? ;
star_target: '*'? target ;
target: name | primary_of ('.' name | '[' slices ']') | '(' targets? ')' | '[' targets? ']' ;
primary_of: atom trailer* ;
trailer: '.' name | '(' args? ')' | '[' slices ']' ;
raise: 'raise' (expr ('from' expr)?)? ;
global: ('global' | 'nonlocal') name (',' name)* ;
import: 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' (('.' | '...')+ dotted? | dotted) 'import' ('*' | '(' imported (',' imported)* ','? ')' | imported (',' imported)*) ;
imported: name ('as' name)? ;
dotted: name ('.' name)* ;
type_alias: 'type' name type_params? '=' expr ;
type_params: '[' type_param (',' type_param)* ','? ']' ;
type_param: ('*' | '**')? name (':' expr)? ('=' expr)? ;
block: NEWLINE INDENT stmt+ DEDENT | simple_line ;
if: 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
while: 'while' named ':' block ('else' ':' block)? ;
for: 'for' targets 'in' star_exprs ':' block ('else' ':' block)? ;
try: 'try' ':' block (('except' (expr ('as' name)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | ('except' '*' expr ('as' name)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) ;
with: 'with' (with_item (',' with_item)* | '(' with_item (',' with_item)* ','? ')') ':' block ;
with_item: expr ('as' star_target)? ;
decorated: ('@' named NEWLINE)+ (function | class | 'async' function) ;
function: 'def' name type_params? '(' params? ')' ('->' expr)? ':' block ;
params: (plain (',' plain)* (',' '/' (',' plain)*)? (',' optional)* (',' '/' (',' optional)*)? | optional (',' optional)* (',' '/' (',' optional)*)?) (',' rest)? ','? | rest ','? ;
plain: name (':' expr)? ;
optional: name (':' expr)? '=' expr ;
rest: '*' name (':' '*'? expr)? (',' (plain | optional))* (',' '**' plain)? | '*' (',' (plain | optional))+ (',' '**' plain)? | '**' plain ;
class: 'class' name type_params? ('(' args? ')')? ':' block ;
async: 'async' (function | for | with) ;
match: 'match' subject ':' NEWLINE INDENT ('case' patterns ('if' named)? ':' block)+ DEDENT ;
subject: star_named (',' star_named)* ','? ;
patterns: open_pattern (',' open_pattern)* ','? ;
open_pattern: '*' name | or_pattern ('as' name)? ;
or_pattern: closed ('|' closed)* ;
closed: ('-'? NUMBER) (('+' | '-') NUMBER)? | string+ | 'None' | 'True' | 'False' | dotted ('(' (class_arg (',' class_arg)* ','?)? ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (map_item (',' map_item)* ','?)? '}' ;
class_arg: name '=' open_pattern | open_pattern ;
map_item: '**' name | ('-'? NUMBER (('+' | '-') NUMBER)? | string+ | dotted | 'None' | 'True' | 'False') ':' open_pattern ;
star_exprs: star_expr (',' star_expr)* ','? ;
star_expr: '*' or_expr | expr ;
star_named: '*' or_expr | named ;
named: name ':=' expr | expr ;
yield: 'yield' ('from' expr | star_exprs)? ;
expr: disjunction ('if' disjunction 'else' expr)? | lambda ;
lambda: 'lambda' (lambda_param (',' lambda_param)* ','?)? ':' expr ;
lambda_param: name ('=' expr)? | '*' name? | '**' name | '/' ;
disjunction: 'not'* unary ((binary | compare | ('and' | 'or') 'not'*) unary)* ;
compare: '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
binary: OPERATOR | '*' | '**' | '-' | '+' | '/' | '|' | '@' ;
or_expr: unary (binary unary)* ;
unary: ('-' | '+' | '~')* 'await'? primary ;
primary: atom trailer* genexp? ;
atom: name | NUMBER | string+ | 'None' | 'True' | 'False' | '...' | '(' (yield | star_named (',' star_named)* ','? | named comp_for)? ')' | '[' (star_named (',' star_named)* ','? | named comp_for)? ']' | '{' (dict_item (',' dict_item)* ','? | expr ':' expr comp_for | star_named (',' star_named)* ','? | named comp_for)? '}' ;
dict_item: '**' or_expr | expr ':' expr ;
genexp: '(' named comp_for ')' ;
comp_for: ('async'? 'for' targets 'in' disjunction ('if' disjunction)*)+ ;
args: (first (',' first)* (',' second)* (',' third)* | second (',' second)* (',' third)* | third (',' third)*) ','? ;
first: '*' expr | named comp_for? ;
second: name '=' expr | '*' expr ;
third: name '=' expr | '**' expr ;
slices: slice (',' slice)* ','? ;
slice: '*' or_expr | named | expr? ':' expr? (':' expr?)? ;
string: STRING | FSTRING_START fpart* FSTRING_END ;
fpart: FSTRING_MIDDLE | '{' (yield | star_exprs) '='? ('!' name)? (':' fpart*)? '}' ;
"""

JSON = r"""
text: value ;
value: object | array | STRING | NUMBER | 'true' | 'false' | 'null' ;
object: '{' (member (',' member)*)? '}' ;
member: STRING ':' value ;
array: '[' (value (',' value)*)? ']' ;
"""


# That an end tag has the name of its start tag is no matter of the grammar; the reader sees to it.
XML = r"""
document: DECLARATION? misc* DOCTYPE? misc* element misc* ;
misc: COMMENT | INSTRUCTION | BLANK ;
element: EMPTY | OPEN (element | misc | TEXT | CDATA)* CLOSE ;
"""

# The rules that are called through the stack; see Grammar.
SQL_CALLS = "expr arith atom query select source table columns type element options dropped ts_one call over sorts gp_parts insert update delete merge group"
PYTHON_CALLS = "stmt block expr unary atom args targets target open_pattern params star_exprs fpart"
JSON_CALLS = "value"


@lru_cache(maxsize=1)
def sql_grammar() -> Grammar:
    return Grammar(SQL, "script", SQL_CALLS)


@lru_cache(maxsize=1)
def python_grammar() -> Grammar:
    return Grammar(PYTHON, "file", PYTHON_CALLS)


@lru_cache(maxsize=1)
def json_grammar() -> Grammar:
    return Grammar(JSON, "text", JSON_CALLS)


@lru_cache(maxsize=1)
def xml_grammar() -> Grammar:
    return Grammar(XML, "document", "element")


# What a comment inside another, or a text between named dollar signs, begins with is taken by
# itself, as is any character that begins no token.
_SQL_TOKEN = re.compile(
    r"""^[ \t]*GO(?:[ \t]+\d+)?[ \t]*;?[ \t]*(?:--[^\n]*)?\r?\n
  |^[ \t]*\\[A-Za-z_!?;.][^\n]*
  |\s*\n|[^\S\n]+|--[^\n]*|﻿
  |/\*[^*/]*+(?:(?:\*(?!/)|/(?!\*))[^*/]*+)*+\*/
  |/\*
  |[nN]?'[^']*+(?:''[^']*+)*+'|[eE]'(?:[^'\\]|\\.|'')*+'|[xXbB]'[0-9a-fA-F]*'|[uU]&'[^']*+(?:''[^']*+)*+'
  |"(?:[^"]|"")++"
  |\$\$.*?\$\$
  |\$[^\W\d]\w*\$
  |\$\d+|:[A-Za-z_]\w*\b(?<!:)|:'[^'\n]*'|:"[^"\n]*"
  |@@?[\w$#]+
  |\[\s*(?:\d+(?:\s*:\s*\d+)?)?\s*\]
  |\[(?:[^\]\n]|\]\])+\]
  |(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w$])|\d[\w$]*
  |(?:[^\W\d]|\#\#?[^\W\d])[\w$\#@]*
  |::|:=|=>|<=|>=|<>|!=|!~\*|!~|~\*|\|\||->>|->|\#>>|\#>|@>|<@|&&|<<|>>|\+=|-=|\*=|.""",
    re.X | re.S | re.M | re.I,
)
_SQL_CLASS = re.compile(
    r"""(?P<GO>[ \t]*GO.*\n\Z)|(?P<skip>\s|--|/\*.|﻿|\\.)|(?P<STRING>(?:[nexb]|u&)?'.*'\Z)|(?P<IDENT>"..+)|(?P<DOLLAR>\$\$.+|\$\w*[^\W\d]\w*\$.+)
  |(?P<PARAMETER>\$\d+|:["'\w].*)|(?P<VARIABLE>@@?[\w$#].*)|(?P<SUBSCRIPT>\[\s*(?:\d+(?:\s*:\s*\d+)?)?\s*\])|(?P<BRACKET>\[.+)|(?P<NUMBER>(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\Z)|(?P<word>\#?\#?[^\W\d].*)""",
    re.X | re.S | re.I,
)
_COMMENT_EDGE = re.compile(r"/\*|\*/")
_OPEN_DOLLAR = re.compile(r"\$[^\W\d]\w*\$\Z")
KEPT_TOKENS, KEPT_LENGTH = 100_000, 64


class SqlKinds(dict):
    """The kind of each token text: 0 for none, -1 for what is no token, -2 for what is opened and
    has to be closed. As many short texts as KEPT_TOKENS are kept; all others are looked at again."""

    def __init__(self) -> None:
        super().__init__()
        g = self.grammar = sql_grammar()
        named = {"IDENT", "BRACKET", "SOFT", "NUMBER", "STRING", "DOLLAR", "VARIABLE", "PARAMETER", "SUBSCRIPT", "GO"}
        reserved = set(RESERVED)
        self.words = {w: g.kind(w) if w in reserved else g.kind(w, "SOFT") for w in g.kinds if (w.isalpha() or "_" in w) and w not in named}
        self.words |= {w: -1 for w in reserved if w not in self.words}

    def __missing__(self, token: str) -> int:
        kind = self.kind_of(token)
        if len(token) <= KEPT_LENGTH:
            if len(self) >= KEPT_TOKENS:
                self.clear()
            self[token] = kind
        return kind

    def kind_of(self, token: str) -> int:
        g = self.grammar
        m = _SQL_CLASS.match(token)
        if token == "/*" or _OPEN_DOLLAR.match(token):
            return -2
        if m is None:
            return g.kinds.get(token, -1)
        if m.lastgroup == "word":
            return self.words.get(token.upper(), g.kinds["IDENT"])
        return 0 if m.lastgroup == "skip" else g.kinds[m.lastgroup]


@lru_cache(maxsize=1)
def sql_kinds() -> SqlKinds:
    return SqlKinds()


def sql_tokens(text: str) -> list[int] | None:
    """Kinds of each token of a script; a word that is a keyword and may be a name has both."""
    of = sql_kinds()
    text += "\n"  # a separator takes its line end
    kinds = list(map(of.__getitem__, _SQL_TOKEN.findall(text)))
    if -2 in kinds:
        kinds = _closed(text, of)
    return None if kinds is None or -1 in kinds else [k for k in kinds if k]


def _closed(text: str, of: SqlKinds) -> list[int] | None:
    """The kinds where comments lie in comments or texts between named dollar signs; None where
    one does not end."""
    out, at, n = [], 0, len(text)
    while at < n:
        token = _SQL_TOKEN.match(text, at)[0]
        kind = of[token]
        at += len(token)
        if kind == -2:
            if token == "/*":
                depth = 1
                while depth:
                    e = _COMMENT_EDGE.search(text, at)
                    if e is None:
                        return None
                    depth += 1 if e[0] == "/*" else -1
                    at = e.end()
                continue
            at = text.find(token, at) + len(token)
            if at < 2 * len(token):
                return None
            kind = of.grammar.kinds["DOLLAR"]
        out.append(kind)
    return out


_JSON_TOKEN = re.compile(r'[ \t\r\n]*+("(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b|[{}\[\],:]|.|\Z)', re.A | re.S)


def json_tokens(text: str) -> list[int] | None:
    k = json_grammar().kinds
    string, number, out = k["STRING"], k["NUMBER"], []
    for token in _JSON_TOKEN.findall(text):
        first = token[:1]
        if first == '"' and len(token) > 1:
            out.append(string)
        elif first.isdecimal() or first == "-" and len(token) > 1:
            out.append(number)
        elif token:
            out.append(k.get(token, -1))
    return None if -1 in out else out


_XML_NAME = r"[A-Za-z_:À-\U000effff][\w:.\-·]*"
XML_ENTITIES = {"lt", "gt", "amp", "apos", "quot"}
_XML_REF = re.compile(rf"&(?:(#\d+|#x[0-9a-fA-F]+|{_XML_NAME});)?")
_XML_ENTITY = re.compile(rf"<!ENTITY\s+({_XML_NAME})\s")
_XML_BAD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")
_XML_TOKEN = re.compile(
    rf"""(?P<comment><!--(?:(?!--).)*-->)
  |(?P<cdata><!\[CDATA\[.*?\]\]>)
  |(?P<declaration><\?xml\s+version\s*=\s*(?:"[\w.\-]+"|'[\w.\-]+')(?:\s+encoding\s*=\s*(?:"[\w.\-]+"|'[\w.\-]+'))?(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>)
  |(?P<instruction><\?(?!xml[\s?])(?:{_XML_NAME})(?:\s.*?)?\?>)
  |(?P<doctype><!DOCTYPE\s+(?:{_XML_NAME})(?:\s+(?:SYSTEM|PUBLIC\s+(?:"[^"]*"|'[^']*'))\s+(?:"[^"]*"|'[^']*'))?\s*(?:\[(?:\s|<!--(?:(?!--).)*-->|<\?(?!xml[\s?])(?:{_XML_NAME})(?:\s.*?)?\?>|<!(?:ENTITY|ELEMENT|ATTLIST|NOTATION)\s+(?:%\s+)?(?:{_XML_NAME})\s(?:"[^"]*"|'[^']*'|[^<>"'])*>|%(?:{_XML_NAME});)*\]\s*)?>)
  |(?P<close></(?P<closed>{_XML_NAME})\s*>)
  |(?P<open><(?P<opened>{_XML_NAME})(?P<attributes>(?:\s+{_XML_NAME}\s*=\s*(?:"[^<"]*"|'[^<']*'))*)\s*(?P<empty>/?)>)
  |(?P<text>[^<]+)""",
    re.X | re.S,
)
_XML_ATTRIBUTE = re.compile(rf"({_XML_NAME})\s*=\s*(\"[^\"]*\"|'[^']*')")


def xml_tokens(text: str) -> list[int] | None:
    """Kinds of the tokens; None also where an end tag has another name than its start tag."""
    k = xml_grammar().kinds
    if _XML_BAD.search(text):
        return None
    if text.startswith("﻿"):
        text = text[1:]
    opened: list[str] = []
    out: list[int] = []
    at, n = 0, len(text)
    declared: set[str] | None = set()
    while at < n:
        m = _XML_TOKEN.match(text, at)
        if m is None:
            return None
        if m["open"] is not None:
            seen = set()
            for a in _XML_ATTRIBUTE.finditer(m["attributes"]):
                if a[1] in seen or "&" in a[2] and not _references(a[2], declared):
                    return None
                seen.add(a[1])
            out.append(k["EMPTY" if m["empty"] else "OPEN"])
            if not m["empty"]:
                opened.append(m["opened"])
        elif m["close"] is not None:
            if not opened or opened.pop() != m["closed"]:
                return None
            out.append(k["CLOSE"])
        elif m["text"] is not None:
            t = m["text"]
            if "]]>" in t or "&" in t and not _references(t, declared):
                return None
            out.append(k["TEXT" if t.strip(" \t\r\n") else "BLANK"])
        else:
            kind = m.lastgroup.upper()
            if kind == "DECLARATION" and at:
                return None
            if kind == "DOCTYPE":
                # What an outer subset or a parameter entity declares is not known.
                outer = re.search(r"^<!DOCTYPE\s+\S+\s+(?:SYSTEM|PUBLIC)|%[^\s%;]+;", m[0])
                declared = None if outer else set(_XML_ENTITY.findall(m[0]))
            out.append(k[kind])
        at = m.end()
    return out


def _references(text: str, declared: set[str] | None) -> bool:
    """Whether each & begins a reference, and, unless declared is None, to what is declared."""
    for m in _XML_REF.finditer(text):
        if m[1] is None or m[1] not in XML_ENTITIES and declared is not None and m[1] not in declared and m[1][0] != "#":
            return False
    return True


_PY_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.TYPE_COMMENT}
_PY_AUGMENT = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}


def python_tokens(text: str) -> list[int] | None:
    k = python_grammar().kinds
    if "\x00" in text:
        return None
    out: list[int] = []
    of = {n: k.get(tokenize.tok_name[n], -1) for n in tokenize.tok_name}
    name, operator = k["NAME"], k["OPERATOR"]
    add = out.append
    try:
        for t in tokenize.generate_tokens(io.StringIO(text.removeprefix("﻿")).readline):
            kind, string = t[0], t[1]
            if kind in _PY_SKIP:
                continue
            if kind == tokenize.NAME:
                add(name if string.isupper() else k.get(string, name))
            elif kind == tokenize.OP:
                c = k.get(string)
                add(c if c is not None else k["AUGMENT"] if string in _PY_AUGMENT else operator)
            else:
                add(of[kind])
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return None
    return None if -1 in out else out
